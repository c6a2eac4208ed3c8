"""Training rows out of a loop's results.

A result: cycle, prompt_id, position (order within the cycle), prompt_text, spec, tier, is_diamond,
timed_out, parsed, violations (array), log, repair_from, repair_violations (array), repair_type and
components (any struct; may be absent). Results of one prompt in one cycle are a group, ranked by
tier and then position.

One aggregation finds what a group needs (its best and last result, the first failure, the first
result that an earlier cycle's gold can mend), with partial aggregates, so that a prompt with very
many results is reduced before it is shuffled; one explode makes the rows. Repairs are rows of their
own results, without those of skipped groups. The cache of gold results is one row a prompt, so
joining it to groups multiplies nothing.

Cases: null tiers rank lowest; null arrays are empty and null texts are the empty text; results
without prompt_id are a group a cycle, which no cached result mends. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logs import feedback
from ..functions.messages import first_final, message
from ..functions.text import short_hash, strip
from .dedup import first_by, new_rows, upsert

# Ranks of tiers, and the wording of the rows.
RANK = {"gold": 3, "silver": 2, "bronze": 1}
WRITE = "Write a TLA+ specification for the following:\n\n"
MODEL_ERRORS = "This TLA+ spec has TLC model-checking errors:\n\nTLC feedback:\n"
SYNTAX_ERRORS = "This TLA+ spec has SANY parse errors (syntax errors):\n\nSANY errors:\n"
CHECKER_ERRORS = "Fix this TLA+ spec. TLC model-checker errors:\n\n"
UNPARSED = "SANY parse errors (spec is syntactically invalid)"
VACUOUS = "TLC passes but spec is semantically vacuous (trivial invariants, no real constraints)"
THOUGHT = {
    "diamond": "I'll write a verified TLA+ specification with meaningful invariants that constrain behavior.",
    "gold": "I'll write a well-formed TLA+ specification with proper Init, Next, and invariants.",
    "bugfix": "I'll analyze the TLC errors and produce a corrected specification.",
    "sany_repair": "I'll fix the SANY parse errors by correcting syntax issues.",
    "rlvr_repair": "I'll fix the TLC errors by bounding the state space, adding UNCHANGED clauses, and declaring any missing CONSTANTS.",
}
#: The developer message; callers give their own.
DEVELOPER = "You write verified formal specifications. Answer with the specification alone."

_ROW = "struct<kind:string,tier:string,row_id:string,messages:array<struct<role:string,channel:string,content:string>>,prompt:string,chosen:string,rejected:string,chosen_tier:string,rejected_tier:string,feedback:string>"


def _prepared(results: DataFrame) -> DataFrame:
    text, many = lambda c: F.coalesce(c, F.lit("")).alias(c), lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    components = F.col("components") if "components" in results.columns else F.lit(None).cast("struct<none:int>")
    return results.select("cycle", "prompt_id", "position", text("prompt_text"), strip(F.coalesce("spec", F.lit(""))).alias("spec"), text("tier"), yes("is_diamond"), yes("timed_out"), yes("parsed"), many("violations"), text("log"), text("repair_from"), many("repair_violations"), text("repair_type"), components.alias("components"))


def base_rank(tier: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)]), tier), F.lit(0))


def _chat(developer: str, user: Column, thought: str, final: Column) -> Column:
    return F.array(message("developer", F.lit(developer)), message("user", user), message("assistant", F.lit(THOUGHT[thought]), "analysis"), message("assistant", final, "final"))


def _sft(tier: str, row_id: Column, messages: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("sft").alias("kind"), F.lit(tier).alias("tier"), row_id.alias("row_id"), messages.alias("messages"), none.alias("prompt"), none.alias("chosen"), none.alias("rejected"), none.alias("chosen_tier"), none.alias("rejected_tier"), none.alias("feedback")).cast(_ROW)


def _dpo(tier: str, row_id: Column, prompt: Column, chosen: Column, rejected: Column, chosen_tier: str, rejected_tier: Column, told: Column) -> Column:
    return F.struct(F.lit("dpo").alias("kind"), F.lit(tier).alias("tier"), row_id.alias("row_id"), F.lit(None).alias("messages"), prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), F.lit(chosen_tier).alias("chosen_tier"), rejected_tier.alias("rejected_tier"), told.alias("feedback")).cast(_ROW)


def _mended(told: Column, broken: Column) -> Column:
    return F.concat(F.lit(MODEL_ERRORS), F.substring(told, 1, 500), F.lit("\n\nBuggy spec:\n"), F.substring(broken, 1, 2000), F.lit("\n\nFix ALL errors and produce a correct spec."))


def gold_cache(results: DataFrame) -> DataFrame:
    """prompt_id, cycle, spec: the first cycle with a gold result keeps its place (insert if absent); of that cycle the last gold result."""
    gold = results.filter("tier = 'gold'").groupBy("prompt_id").agg(F.max_by(F.struct("cycle", "spec"), F.struct(-F.col("cycle"), "position")).alias("g"))
    return gold.select("prompt_id", F.col("g.cycle").alias("cycle"), strip(F.coalesce("g.spec", F.lit(""))).alias("spec"))


def insert_if_absent(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache and the gold results of prompts that it hasn't."""
    fresh = new_rows(gold_cache(results), cache, "prompt_id", ["cycle"])
    return cache.select("prompt_id", "cycle", "spec").unionByName(fresh)


def training_rows(results: DataFrame, cache: DataFrame | None = None, developer: str = DEVELOPER) -> DataFrame:
    """cycle, prompt_id, kind (sft or dpo), tier, row_id, messages or prompt, chosen, rejected, chosen_tier, rejected_tier, feedback, and components of the best result.

    Five kinds. The best result of a group is an example if it is a diamond, else if it is gold; a
    diamond is preferred to the group's last, lesser result; the first silver or bronze result with
    errors and a gold best is a bug fix; a gold result that was a repair is an example and a
    preference; and the first failure of a group without gold is mended by the gold of an earlier
    cycle. A group whose best result timed out short of gold gives the last kind alone. cache:
    gold_cache() of earlier results, by default that of results themselves.
    """
    r = _prepared(results)
    rank = base_rank(F.col("tier")) + F.col("is_diamond").cast("int")
    faulty = F.size("violations") > 0
    of = F.struct((-rank).alias("less"), "position", *[c for c in r.columns if c not in ("cycle", "prompt_id", "position", "repair_from", "repair_violations", "repair_type", "components")])
    mends = (F.col("tier") == "silver") & faulty | (F.col("tier") == "bronze") & ~F.col("parsed")
    groups = r.groupBy("cycle", "prompt_id").agg(
        F.min(of).alias("best"), F.max(of).alias("last"), F.min_by("components", F.struct(-rank, "position")).alias("components"), F.max(F.col("tier") == "gold").alias("any_gold"),
        F.min(F.when(F.col("tier").isin("silver", "bronze") & (faulty | ~F.col("parsed")), of)).alias("fault"), F.min(F.when(mends, of)).alias("open"),
    )
    known = (gold_cache(results) if cache is None else cache).select("prompt_id", F.col("cycle").alias("gold_cycle"), F.col("spec").alias("gold"))
    groups = groups.join(known, "prompt_id", "left")
    best, last, fault, open_ = (lambda f, name=name: F.col(f"{name}.{f}") for name in ("best", "last", "fault", "open"))
    told = lambda x: feedback(x("log"), x("violations"))
    errors = lambda x: F.size(x("violations")) > 0
    skipped = best("timed_out") & (best("tier") != "gold")
    pid = F.coalesce(F.col("prompt_id").cast("string"), F.lit(""))
    ask = lambda x: F.concat(F.lit(WRITE), x("prompt_text"))
    example = [F.when(~skipped & hit, _sft(tier, pid, _chat(developer, ask(best), tier, best("spec")))) for tier, hit in (("diamond", best("is_diamond")), ("gold", ~best("is_diamond") & (best("tier") == "gold")))]
    reason = F.when(errors(last), F.array_join(F.slice(last("violations"), 1, 5), "\n")).when(~last("parsed"), UNPARSED).when(last("tier") == "gold", VACUOUS).otherwise(F.concat(F.lit("TLC failed ("), last("tier"), F.lit(") vs diamond")))
    prefer = F.when(~skipped & best("is_diamond") & ~last("is_diamond") & (last("less") > best("less")), _dpo("diamond", pid, ask(best), best("spec"), last("spec"), "diamond", last("tier"), reason))
    fix_told = F.when(errors(fault), told(fault)).otherwise("SANY parse errors")
    fix = F.when(~skipped & (best("tier") == "gold") & F.col("fault").isNotNull() & (fix_told != ""), _sft("bugfix", F.concat(pid, F.lit("_bugfix")), _chat(developer, _mended(fix_told, fault("spec")), "bugfix", best("spec"))))
    late = ~F.col("any_gold") & F.col("open").isNotNull() & (F.col("gold") != "") & (F.col("gold_cycle") < F.col("cycle"))
    silver = open_("tier") == "silver"
    cross = F.when(late & silver & (told(open_) != ""), _sft("cross_cycle_bugfix", F.concat(pid, F.lit("_xcycle")), _chat(developer, _mended(told(open_), open_("spec")), "bugfix", F.col("gold"))))
    cross_syntax = F.when(late & ~silver, _sft("cross_cycle_syntax", F.concat(pid, F.lit("_xcycle_syn")), _chat(developer, ask(open_), "gold", F.col("gold"))))
    from_groups = groups.select("cycle", "prompt_id", "components", F.explode(F.array_compact(F.array(*example, prefer, fix, cross, cross_syntax))).alias("row"))

    mended = r.filter((F.col("tier") == "gold") & (F.col("repair_from") != "") & (F.size("repair_violations") > 0))
    left_out = groups.filter(skipped).select("cycle", "prompt_id")
    mended = mended.join(left_out, ["cycle", "prompt_id"], "left_anti")
    syntax = F.col("repair_type") == "sany"
    said = F.array_join(F.filter(F.slice("repair_violations", 1, 6), lambda v: ~F.contains(v, F.lit("TLC_TIMEOUT"))), "\n")
    broken = strip(F.col("repair_from"))
    cut = lambda n: F.concat(F.substring(said, 1, n), F.lit("\n\nBroken spec:\n"), F.substring(broken, 1, 2000 if n == 600 else 1500))
    pairs = [F.when(syntax, _sft("sany_repair", F.concat(pid, F.lit("_sany_repair")), _chat(developer, F.concat(F.lit(SYNTAX_ERRORS), cut(600), F.lit("\n\nFix ALL syntax errors and produce a correct spec.")), "sany_repair", F.col("spec")))).otherwise(_sft("rlvr_repair", F.concat(pid, F.lit("_rlvr")), _chat(developer, F.concat(F.lit(CHECKER_ERRORS), cut(600)), "rlvr_repair", F.col("spec"))))]
    pairs.append(F.when(syntax, _dpo("sany_repair", pid, F.concat(F.lit("Fix this TLA+ spec. SANY parse errors:\n"), cut(500)), F.col("spec"), broken, "gold", F.lit("bronze"), said)).otherwise(_dpo("rlvr_repair", pid, F.concat(F.lit("Fix this TLA+ spec. TLC errors:\n"), cut(500)), F.col("spec"), broken, "gold", F.lit("silver"), said)))
    from_repairs = mended.select("cycle", "prompt_id", "components", F.explode(F.array(*pairs)).alias("row"))
    return from_groups.unionByName(from_repairs).select("cycle", "prompt_id", "row.*", "components")


def new_examples(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The sft rows whose final message isn't there yet, by 16 digits of its SHA-256: neither among existing rows (with messages) nor among earlier cycles and ids."""
    hashed = rows.filter("kind = 'sft'").withColumn("content_hash", short_hash(strip(first_final(F.col("messages"))), 16))
    order = ["cycle", "row_id", "tier", F.sha2(F.to_json("messages"), 256)]
    if existing is None:
        return first_by(hashed, ["content_hash"], order)
    return new_rows(hashed, existing.select(short_hash(strip(first_final(F.col("messages"))), 16).alias("content_hash")), "content_hash", order)


def merged_pairs(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored preference pairs with the gold ones of rows: one of each prompt's first 200 characters, replaced only by a higher tier."""
    key = F.substring("prompt", 1, 200)
    columns = ["prompt", "chosen", "rejected", "chosen_tier", "rejected_tier"]
    value = F.greatest(base_rank(F.col("chosen_tier")), F.when(F.col("chosen_tier") == "bugfix", 3).otherwise(0))
    keyed = lambda df: df.select(*columns, key.alias("prompt_key"), value.alias("value"))
    fresh = first_by(keyed(rows.filter("kind = 'dpo' and chosen_tier = 'gold'")), ["prompt_key"], ["prompt", "chosen", "rejected"])
    return upsert(keyed(existing), fresh, "prompt_key", "value").select(*columns)


def gold_against_latest(gold: DataFrame, results: DataFrame, least: int = 50) -> DataFrame:
    """Pairs of a gold text (prompt_id, prompt_text, spec) and the latest result's text of that prompt, if that has `least` characters."""
    latest = results.groupBy("prompt_id").agg(F.max_by("spec", F.struct("cycle", "position")).alias("rejected"))
    both = gold.join(latest, "prompt_id").filter(F.length(strip(F.col("rejected"))) >= least)
    return both.select("prompt_id", F.concat(F.lit(WRITE), "prompt_text").alias("prompt"), strip(F.col("spec")).alias("chosen"), strip(F.col("rejected")).alias("rejected"), F.lit("gold").alias("chosen_tier"), F.lit("bronze").alias("rejected_tier"))
