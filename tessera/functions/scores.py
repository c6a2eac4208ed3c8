"""Scores, classes and rewards as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import line_count

#: Ranks of the quality tiers, rewards and weights.
TIER_RANK = {"diamond": 4, "gold": 3, "silver": 2, "bronze": 1}
PROOF_RANK = {"proved": 4, "partial": 3, "unproved": 2, "timeout": 1, "parse_error": -1}
PIECE_ORDER = ("VARIABLES", "TypeOK", "Init", "Next", "Invariants", "full_spec")
COMPONENT_WEIGHTS = {"init_present": 0.05, "next_present": 0.05, "init_level_ok": 0.10, "next_level_ok": 0.10, "invariants_declared": 0.10, "tlc_depth1_ok": 0.25, "tlc_full_ok": 0.35}
Z95 = 1.959963984540054

#: Patterns that count towards a specification's richness.
RICH_PATTERNS = (r"\\E\s", r"\\A\s", "<>", r"\[\]", "~>", "WF_", "SF_", "ENABLED", "UNCHANGED", "CHOOSE", r"\\in\b", r"\\notin\b", "SUBSET", "UNION", r"\\times\b", r"Seq\s*\(", "INSTANCE", r"MODULE\s+\w+\s+WITH")

#: Topics in order and the words that tell them.
TOPICS = (
    ("mutex", ("mutual exclusion", "mutex", "critical section")),
    ("consensus", ("paxos", "raft", "consensus", "leader election", "vote")),
    ("queue", ("queue", "producer", "consumer", "buffer", "fifo")),
    ("lock", ("lock", "read-write", "semaphore")),
    ("protocol", ("gossip", "token ring", "commit", "snapshot", "retransmission")),
    ("algorithm", ("bakery", "peterson", "dekker", "dining", "philosopher")),
    ("data_structure", ("stack", "key-value", "counter", "register", "dag")),
    ("state_machine", ("traffic", "vending", "elevator", "door", "toggle", "clock")),
    ("allocator", ("allocator", "resource", "broker", "publish")),
    ("transaction", ("transaction", "isolation", "consistent")),
)

#: Error classes of a failed check, all of them, for zero-filled counts.
ERROR_CLASSES = ("syntax", "timeout", "deadlock", "invariant_violation", "unbounded_state", "undefined_op", "other")
DOMAINS = ("networking", "storage", "scheduling", "consensus", "transaction", "concurrency", "memory", "other")


def rank_of(tier: Column, ranks: dict[str, int] = TIER_RANK, unknown: int = 0) -> Column:
    """A rank by a literal map; tiers are never compared as strings."""
    pairs = [F.lit(x) for kv in ranks.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), tier), F.lit(unknown))


def piece_rank(piece: Column) -> Column:
    return rank_of(piece, {p: i for i, p in enumerate(PIECE_ORDER)}, 99)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes")


def share_of(*checks: Column) -> Column:
    """How many of the checks hold, over their number."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks]) / F.lit(float(len(checks)))


def richness(spec: Column) -> Column:
    return reduce(lambda a, b: a + b, [spec.rlike(p).cast("int") for p in RICH_PATTERNS])


# What counts as a comment (a block comment only at the start of a line) and as an invariant.
COMMENT_PATTERN = r"(?m)(\\\*|^\s*\(\*)"
INVARIANT_PATTERN = r"(?mi)^(TypeOK|Safety|Inv|.*Invariant)\s*=="


def quality(spec: Column) -> Column:
    """struct: raw score 0-10, overall 1-5 (halves to even), and the features they come from."""
    n, rich = line_count(spec), richness(spec)
    comments, invariants = spec.rlike(COMMENT_PATTERN), spec.rlike(INVARIANT_PATTERN)
    liveness, primed, quantified = spec.rlike(r"(?m)(ENABLED|<>|^\[\]|~>|WF_|SF_)"), spec.rlike(r"[a-zA-Z_]\w*'"), spec.rlike(r"\\E\s|\\A\s|∃|∀")
    raw = F.when(n.between(50, 500), 2).when(n.between(20, 49) | n.between(501, 1000), 1).otherwise(0) + comments.cast("int") + 2 * invariants.cast("int") + liveness.cast("int")
    raw = raw + F.when(rich >= 5, 2).when(rich >= 2, 1).otherwise(0) + primed.cast("int") + quantified.cast("int")
    overall = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(raw / 2, 0).cast("int")))
    return F.struct(overall.alias("overall"), raw.alias("raw_score"), n.alias("line_count"), rich.alias("operator_richness"), comments.alias("has_comments"), invariants.alias("has_invariants"), liveness.alias("has_liveness"), primed.alias("has_primed"), quantified.alias("has_quantifiers"))


def structure(spec: Column) -> Column:
    """Share of eight parts that a whole specification has."""
    return share_of(*[spec.rlike(p) for p in (r"----\s*MODULE\s+\w+\s*----", r"EXTENDS\s+\w+", r"VARIABLES?\s+", r"Init\s*==", r"Next\s*==", r"Spec\s*==", r"TypeOK\s*==", "====")])


def structure_with(spec: Column, expected: Column) -> Column:
    """Share of nine checks, the last that one of the expected names is defined."""
    parts = [r"----\s*MODULE", "====", r"\bEXTENDS\b", r"\bVARIABLES\b", r"(?m)^Init\s*==", r"(?m)^Next\s*==", r"(?m)^Spec\s*==", r"(?m)^TypeOK\s*=="]
    return share_of(*[spec.rlike(p) for p in parts], F.exists(expected, lambda n: defines(spec, n)))


def defines(spec: Column, name: Column) -> Column:
    """Whether a definition of the name begins a line."""
    return F.regexp_like(spec, F.concat(F.lit(r"(?m)^\Q"), name, F.lit(r"\E\s*==")))


def expected_overlap(spec: Column, expected: Column) -> Column:
    """How many of the expected names a definition at the start of a line has."""
    return F.size(F.filter(expected, lambda n: defines(spec, n)))


def complexity(spec: Column) -> Column:
    """Share of ten features."""
    breaks = F.length(spec) - F.length(F.replace(spec, F.lit("\n"), F.lit("")))
    parts = [spec.rlike(p) for p in (r"\\E\b|\\A\b", "SUBSET", r"\[.*->.*\]", "Sequences", "WF_|SF_", r"CONSTANT\s+\w+.*\n.*CONSTANT|CONSTANTS", "RECURSIVE|INSTANCE|THEOREM")]
    return share_of(*parts, breaks >= 40, breaks >= 60, F.regexp_count(spec, F.lit(r"(?m)^\w+\s*==")) >= 6)


def topic(text: Column) -> Column:
    """The first topic in order that a word of it tells; other."""
    low = F.lower(text)
    out = None
    for name, words in TOPICS:
        told = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(told, name) if out is None else out.when(told, name)
    return out.otherwise("other")


def error_class(parsed: Column, timed_out: Column, log: Column) -> Column:
    """Ordered cascade of a failed check's class."""
    low = F.lower(F.coalesce(log, F.lit("")))
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in w])
    return F.when(~F.coalesce(parsed, F.lit(False)), "syntax").when(timed_out, "timeout").when(has("deadlock"), "deadlock").when(has("invariant") & has("violated"), "invariant_violation").when(has("not enumerable", "cannot enumerate", "overflow"), "unbounded_state").when(has("undefined", "unknown operator"), "undefined_op").otherwise("other")


def model_class(model: Column, tuned: str, base: str = "gpt-oss") -> Column:
    """fine-tuned or base by the name before the colon, else general."""
    return F.when(model.startswith(f"{tuned}:"), "fine-tuned").when(model.startswith(f"{base}:"), "base").otherwise("general")


def wilson(k: Column, n: Column) -> Column:
    """struct(low, high): the 95 % Wilson interval, in [0, 1]; (0, 0) without trials."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    none = n <= 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("low"), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"))


def shaped_reward(before: Column, after: Column) -> Column:
    """Reward of an improvement: a dead band of 0.01 either side, bonuses where a threshold is passed."""
    d = after - before
    bonus = F.when((before < 0.10) & (after >= 0.10), 0.1).otherwise(0.0) + F.when((before < 0.40) & (after >= 0.40), 0.1).otherwise(0.0) + F.when(after >= 1.0, 0.1).otherwise(0.0)
    return F.when(d < -0.01, F.greatest(F.lit(0.0), 0.1 + d)).when(d < 0.01, 0.15).otherwise(F.least(F.lit(1.0), 0.2 + d * 0.6 + bonus))


def component_credit(**verdicts: Column) -> Column:
    """Weighted credit of the component verdicts, 4 decimals."""
    return F.round(reduce(lambda a, b: a + b, [F.when(verdicts[k], w).otherwise(0.0) for k, w in COMPONENT_WEIGHTS.items()]), 4)


def tier_reward(tier: Column, violations: Column, parsed: Column | None = None) -> Column:
    """Reward of a checked completion; violations null counts as five, no completion as zero."""
    n = F.coalesce(violations, F.lit(5))
    graded = F.when(tier == "gold", 1.0).when(tier == "silver", 0.5).when(n == 0, 0.35).when(n <= 2, 0.25).when(n <= 5, 0.15).otherwise(0.10)
    return F.when(tier.isNull(), 0.05).otherwise(graded) if parsed is None else F.when(~parsed, 0.0).when(tier.isNull(), 0.05).otherwise(graded)


def semantic_score(coverage: Column, invariants: Column, caught: Column) -> Column:
    return 0.4 * coverage + 0.4 * F.when(invariants > 0, 1.0).otherwise(0.0) + 0.2 * F.when(caught, 1.0).otherwise(0.0)


def ladder(parsed: Column, reached: Column, meaningful: Column, caught: Column) -> Column:
    """Steps of the ladder that hold from the first on: 0 to 4."""
    return F.when(~parsed, 0).when(~reached, 1).when(~meaningful, 2).when(~caught, 3).otherwise(4)


def is_diamond(states: Column, trivial: Column, invariants: Column, tested: Column, caught: Column) -> Column:
    return (states > 1) & ~trivial & (invariants > 0) & tested & caught


def difficulty_cap(parse_rate: Column, check_rate: Column) -> Column:
    base = F.when(parse_rate >= 0.8, 5).when(parse_rate >= 0.6, 4).when(parse_rate >= 0.4, 3).otherwise(2)
    return F.when(check_rate < 0.12, F.least(base, F.lit(3))).when(check_rate < 0.22, F.least(base, F.lit(4))).otherwise(base)


def difficulty_band(score: Column) -> Column:
    return F.when(score < 0.10, "easy").when(score < 0.40, "medium").otherwise("hard")


NUMBER = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"


def answer(text: Column) -> Column:
    """The tagged number, else the last number of the text, commas out; null if there is none."""
    tagged = F.nullif(F.regexp_extract(text, rf"<answer>\s*{NUMBER}\s*</answer>", 1), F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), 1), F.lit(-1))
    return F.replace(F.coalesce(tagged, last), F.lit(","), F.lit(""))


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(-?[0-9]+)", 1), F.lit(""))


def answer_reward(found: Column, wanted: Column) -> Column:
    """1 if the numbers agree to 1e-6, 0.1 for any other answer, 0 for none."""
    same = F.coalesce(F.abs(found.try_cast("double") - wanted.try_cast("double")) < 1e-6, F.lit(False))
    return F.when(found.isNull(), 0.0).when(same, 1.0).otherwise(0.1)


def night(ts: Column) -> Column:
    return (F.hour(ts) >= 22) | (F.hour(ts) < 6)


def known_or_other(value: Column, allowed: tuple[str, ...] = DOMAINS) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*allowed), low).otherwise("other")


def map_mean(scores: Column) -> Column:
    """Mean of a map's values; 0 for an empty one."""
    v = F.map_values(scores)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0)
