"""One record to several rows: tasks, stages, mutations, sub-tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modules
from ..functions.messages import message
from ..functions.text import strip
from .sampling import choose


def _chat(*parts: Column) -> Column:
    return F.array(*parts)


def generation(description: Column, spec: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", _chat(message("user", F.concat(F.lit("Write a specification: "), description)), message("assistant", spec, "final")))


def completion(spec: Column, least: int = 10) -> Column:
    """Split after the first VARIABLES line past the fifth, else after a third; null for short texts."""
    lines = F.split(spec, "\n")
    found = F.array_position(F.transform(lines, lambda x, i: F.coalesce((i > 4) & x.startswith("VARIABLES"), F.lit(False))), F.lit(True)).cast("int")
    cut = F.when(found > 0, found).otherwise(F.floor(F.size(lines) / 3).cast("int"))
    head, rest = F.slice(lines, F.lit(1), F.greatest(cut, F.lit(0))), F.slice(lines, cut + 1, F.size(lines))
    return F.when(F.size(lines) >= least, _chat(message("user", F.concat(F.lit("Complete:\n"), F.array_join(head, "\n"))), message("assistant", F.array_join(rest, "\n"), "final")))


def invariant_task(spec: Column) -> Column:
    block = modules.invariant_block(spec)
    return F.when(spec.rlike(r"(?m)^(TypeOK|Inv)\s*==") & (block != ""), _chat(message("user", F.concat(F.lit("Give the invariants of:\n"), spec)), message("assistant", block, "final")))


def bug_fix(broken: Column, error: Column, fixed: Column) -> Column:
    return F.when(broken != fixed, _chat(message("user", F.format_string("Fix the spec. Errors: %s\n%s", error, broken)), message("assistant", fixed, "final")))


def tasks(df: DataFrame, id_: str, description: str, spec: str) -> DataFrame:
    """id, task, messages."""
    d, s = F.col(description), F.col(spec)
    kinds = {"generation": generation(d, s), "completion": completion(s), "invariant": invariant_task(s), "bug_fix": bug_fix(s, F.lit("stray ;"), F.replace(s, F.lit(";"), F.lit("")))}
    rows = F.array_compact(F.array(*[F.when(m.isNotNull(), F.struct(F.lit(k).alias("task"), m.alias("messages"))) for k, m in kinds.items()]))
    return df.select(id_, F.explode_outer(rows).alias("t")).filter("t is not null").select(id_, "t.task", "t.messages")


# What invariants are called, words that stay whole, and the head of the list of properties.
PROPERTY = r"^(?:TypeOK$|Safety|.*Inv(?:ariant)?$|Mutex|MutualExclusion|Conservation|Bounded|NoOverflow|NoUnderflow|AtMost|NoWrite|Valid|.*Conserved|.*Bounded|.*Stable|.*Threshold)"
NOT_PROPERTIES = ("Init", "Next", "Spec", "vars")
ACRONYMS = ("OK", "ID", "FIFO", "LIFO", "ACK", "NACK", "RPC")
PROPERTIES_HEAD = "**Required properties for this system:**\n"


def section(spec: Column, name: str) -> Column:
    """The first definition of the name with its lines up to the next definition at the start of a line or the end bar, without blank and comment lines at its end; null if there is none."""
    block = F.regexp_extract(spec, rf"(?s)(?:\A|\n)([^\S\n]*{name}[^\S\n]*==.*?)(?=\n[A-Za-z_]\w*[^\S\n]*==|\n={{4,}}|\z)", 1)
    lines = F.split(block, "\n")
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*(?:\z|\\\*|\(\*)"), 0).otherwise(i + 1)))
    return F.when(block != "", F.array_join(F.slice(lines, F.lit(1), last), "\n"))


def _readable(name: Column) -> Column:
    """A name's words, apart; acronyms that were cut in two are joined again."""

    def add(words: Column, word: Column) -> Column:
        joined = F.concat(F.try_element_at(words, F.lit(-1)), word)
        return F.when(F.coalesce(joined.isin(*ACRONYMS), F.lit(False)), F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(joined))).otherwise(F.concat(words, F.array(word)))

    words = F.regexp_extract_all(name, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]*|[a-z]+"), F.lit(0))
    return F.when(F.size(words) == 0, name).otherwise(F.array_join(F.aggregate(words, F.array().cast("array<string>"), add), " "))


def properties(spec: Column) -> Column:
    """A list of the module's invariants in words; null if it has none."""
    names = F.filter(F.regexp_extract_all(spec, F.lit(r"(?m)^\s*(\w+)\s*=="), F.lit(1)), lambda n: n.rlike(PROPERTY) & ~n.isin(*NOT_PROPERTIES))
    lines = F.transform(names, lambda n: F.concat(F.lit("- `"), n, F.lit("` \u2014 "), _readable(n)))
    return F.when(F.size(names) > 0, F.array_join(F.concat(F.array(F.lit(PROPERTIES_HEAD)), lines), "\n"))


def multitask(df: DataFrame, id_: str, description: str, spec: str) -> DataFrame:
    """id, task, messages: the whole module, its rest after Init, its Next, its Init from the declarations, and its properties.

    Tasks that a module lacks the parts for are left out, and so are rows whose description or text
    is null or blank. Of rows with the same id, task and answer the one of the smallest prompt stays.
    """
    s, d = F.col("spec"), F.col("description")
    init, step, typed = section(s, "Init"), section(s, "Next"), section(s, "TypeOK")
    to_init = F.position(init, s) + F.length(init) - 1
    rest = strip(F.substring(s, to_init + 1, F.length(s)))
    at = F.position(step, s)
    masked = F.concat(F.substring(s, F.lit(1), at - 1), F.lit("Next == \\* TODO: fill in transition relation"), F.substring(s, at + F.length(step), F.length(s)))
    declared = strip(F.nullif(F.regexp_extract(s, r"(?md)^\s*VARIABLES?\s+.+$", 0), F.lit("")))
    fixed = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(?md)^\s*CONSTANTS?\s+.+$"), F.lit(0)), lambda x: F.concat(strip(x), F.lit("\n"))), "")
    kinds = {
        "full_gen": (F.concat(F.lit("Write a specification of this system.\n\n"), d), strip(s)),
        "completion": (F.concat(F.lit("Add what is missing after Init.\n\n"), d, F.lit("\n\n"), F.substring(s, F.lit(1), to_init)), F.when(F.contains(rest, F.lit("Next")), rest)),
        "infill_next": (F.concat(F.lit("Write the missing Next.\n\n"), d, F.lit("\n\n"), masked), step),
        "segment_init": (F.concat(F.lit("Write an Init that satisfies TypeOK.\n\n"), d, F.lit("\n\n"), fixed, declared, F.lit("\n\n"), typed), init),
        "req_analysis": (F.concat(F.lit("List the properties that this system must have.\n\n"), d), properties(s)),
    }
    rows = F.array_compact(F.array(*[F.when(F.concat(ask, answer).isNotNull(), F.struct(F.lit(k).alias("task"), answer.alias("answer"), ask.alias("ask"))) for k, (ask, answer) in kinds.items()]))
    whole = df.select(F.col(id_).alias("id"), F.col(description).alias("description"), F.col(spec).alias("spec")).filter((strip(d) != "") & (strip(s) != ""))
    best = whole.select("id", F.explode(rows).alias("t")).groupBy("id", "t.task", "t.answer").agg(F.min("t.ask").alias("ask"))
    return best.select(F.col("id").alias(id_), "task", _chat(message("user", F.col("ask")), message("assistant", F.col("answer"), "final")).alias("messages"))


STAGES = ("header", "TypeOK", "Init", "Next", "Spec")


def staged(df: DataFrame, id_: str, spec: str) -> DataFrame:
    """id, stage, place, prefix (text of all stages before), body; stages that a module lacks are left out."""
    s = F.col(spec)
    header = F.regexp_extract(s, r"(?s)^(.*?)(?=\n\w+\s*==|\z)", 1)
    bodies = [header, *[F.concat(F.lit(f"{n} == "), modules.body(s, n)) for n in STAGES[1:]]]
    parts = F.array_compact(F.array(*[F.when(b.isNotNull() & (b != ""), F.struct(F.lit(n).alias("stage"), b.alias("body"))) for n, b in zip(STAGES, bodies, strict=True)]))
    # A plain explode brings a filter on the parts, which goes below the rows' deal to tasks and finds all parts once more there.
    rows = df.filter(F.length(s) > 0).select(id_, parts.alias("parts")).select(id_, "parts", F.posexplode_outer("parts").alias("place", "p")).filter("p is not null")
    prefix = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("place")), lambda p: p["body"]), "\n")
    return rows.select(id_, "place", F.col("p.stage").alias("stage"), prefix.alias("prefix"), F.col("p.body").alias("body"))


#: Ways to spoil a text, by name.
MUTATORS = {
    "semicolons": lambda s: F.regexp_replace(s, r"(?m)(==.*)$", "$1;"),
    "drop_terminator": lambda s: F.regexp_replace(s, r"(?m)^={4,}\s*$", ""),
    "fence": lambda s: F.concat(F.lit("```\n"), s, F.lit("\n```")),
    "think": lambda s: F.concat(F.lit("<think>first</think>\n"), s),
    "drop_unchanged": lambda s: F.regexp_replace(s, r"\s*/\\\s*UNCHANGED\s+[^\n]*", ""),
    "extra_header": lambda s: F.concat(F.lit("---- MODULE Extra ----\n"), s),
    "unicode": lambda s: F.replace(s, F.lit("\\in"), F.lit("∈")),
}


def mutated(df: DataFrame, id_: str, spec: str, k: int = 2, seed: str = "42") -> DataFrame:
    """id, mutator, broken, fixed: k mutators a row in hash order, without those that change nothing."""
    s = F.col(spec)
    names = choose(F.array(*map(F.lit, MUTATORS)), F.col(id_), k, seed)
    broken = None
    for name, change in MUTATORS.items():
        broken = F.when(F.col("mutator") == name, change(s)) if broken is None else broken.when(F.col("mutator") == name, change(s))
    return df.select(id_, spec, F.explode(names).alias("mutator")).select(id_, "mutator", broken.alias("broken"), s.alias("fixed")).filter("broken <> fixed")


# Seven syntax errors to repair, by name: pattern and replacement of its first place (every place for remove_closing).
SYNTAX_ERRORS = {
    "remove_closing": ("====", ""),
    "double_prime": (r"(\w)'(\s)", "$2''$3"),
    "remove_extends": (r"(?m:^)EXTENDS\s+.*(?m:$)", ""),
    "bad_keyword": ("VARIABLES", "VAR"),
    "pluscal_leak": ("Init ==", "begin\nInit =="),
    "bad_unchanged": (r"UNCHANGED\s*<<([^>]+)>>", "UNCHANGED $2"),
    "const_equals": (r"(?m:^)(CONSTANTS?\s+\w+)\s*(?m:$)", "$2 = 5"),
}


def with_syntax_error(spec: Column, name: str) -> Column:
    pattern, new = SYNTAX_ERRORS[name]
    if name == "remove_closing":
        return F.replace(spec, F.lit(pattern), F.lit(new))
    return F.regexp_replace(spec, rf"(?s)\A(.*?)(?-s:{pattern})", f"$1{new}")


def syntax_repairs(df: DataFrame, id_: str, spec: str, k: int = 2, seed: str = "42") -> DataFrame:
    """id, mutation, broken, fixed, messages: k of the errors a row in hash order, without those that change nothing; none for texts under ten lines."""
    s = strip(F.col(spec))
    names = choose(F.array(*map(F.lit, SYNTAX_ERRORS)), F.col(id_), k, seed)
    broken = F.coalesce(*[F.when(F.col("mutation") == n, with_syntax_error(F.col("fixed"), n)) for n in SYNTAX_ERRORS])
    rows = df.select(id_, s.alias("fixed"), F.explode(names).alias("mutation")).filter(F.size(F.split("fixed", "\n")) >= 10)
    error = F.concat(F.lit("parse error after the mutation "), F.col("mutation"))
    return rows.withColumn("broken", broken).filter(strip(F.col("broken")) != F.col("fixed")).select(id_, "mutation", "broken", "fixed", bug_fix(F.col("broken"), error, F.col("fixed")).alias("messages"))


def variant(spec: Column, renames: dict[str, str], suffix: str = "Variant") -> Column:
    """The module under another name, with identifiers renamed."""
    for old, new in renames.items():
        spec = F.regexp_replace(spec, rf"\b{old}\b", new)
    return F.regexp_replace(spec, r"(----\s*MODULE\s+)(\w+)", rf"$1$2{suffix}")


def decomposed(df: DataFrame, id_: str, spec: str) -> DataFrame:
    """id, part, body of the first lines of Init and Next, the last definition of each name."""
    s = F.col(spec)
    one = lambda n: F.nullif(F.regexp_extract(s, rf"(?m)^{n}\s*==\s*([^\n]*)", 1), F.lit(""))
    parts = F.array_compact(F.array(*[F.when(one(n).isNotNull(), F.struct(F.lit(n.lower()).alias("part"), one(n).alias("body"))) for n in ("Init", "Next")]))
    return df.select(id_, F.explode_outer(parts).alias("p")).filter("p is not null").select(id_, "p.part", "p.body")


def theorem_chunks(df: DataFrame, id_: str, spec: str) -> DataFrame:
    """id, place, preamble, statement, proof: one row a theorem; its proof is the numbered steps and OBVIOUS or BY lines after the statement."""
    s = F.col(spec)
    pattern = F.lit(r"(?ms)^((?:THEOREM|LEMMA)\b.*?)(?=^(?:THEOREM|LEMMA)\b|^={4,}|\z)")
    rows = df.select(id_, F.regexp_extract(s, r"(?s)^(.*?)(?m:^(?:THEOREM|LEMMA)\b)", 1).alias("preamble"), F.posexplode(F.regexp_extract_all(s, pattern, 1)).alias("place", "block"))
    statement = F.regexp_extract("block", r"(?s)^(.*?)(?m:^\s*(?:<\d+>|OBVIOUS|BY\b|PROOF\b))", 1)
    whole = F.when(statement == "", F.col("block")).otherwise(statement)
    return rows.select(id_, "place", "preamble", strip(whole).alias("statement"), strip(F.substring("block", F.length(whole) + 1, F.length("block"))).alias("proof"))
