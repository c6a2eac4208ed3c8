"""Queries over specification texts. The driver's tables hold none, so they are written from part's columns, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixer, logs, modules, rewrite, sanitiser, scores, text
from ..operators import generators, verify
from .registry import Registry, dealt, table

registry = Registry()

#: Lines of the synthetic modules: a condition on the part's key and size, and the line. {k} is the key.
LINES = (
    ("true", "---- MODULE {m}{k} ----"),
    ("p_partkey % 11 <> 0", "EXTENDS Naturals, Sequences"),
    ("p_partkey % 11 = 0", "EXTENDS Core{k}, TLC"),
    ("p_size % 3 = 0", "CONSTANTS N, Servers"),
    ("p_partkey % 13 <> 0", "VARIABLES x, queue"),
    ("p_size % 2 = 0", "\\* a comment; with a mark"),
    ("p_partkey % 10 = 3", "  (* a block comment *)"),
    ("p_partkey % 10 = 7", "Low == x (* inline *)"),
    ("p_partkey % 5 <> 0", "TypeOK == x \\in 0..N"),
    ("p_partkey % 7 = 0", "Inv == TRUE"),
    ("true", "Init == x = 0;"),
    ("p_partkey % 17 <> 0", "Next == x' = x + 1 /\\ UNCHANGED queue"),
    ("p_partkey % 19 = 0", "Next == x' = x"),
    ("p_size % 4 = 0", "Live == <>(x = 3)"),
    ("p_size % 5 = 0", "Safe == \\A i \\in 1..3 : x >= 0"),
    ("p_partkey % 3 <> 0", "Spec == Init /\\ [][Next]_x /\\ WF_x(Next)"),
    ("p_partkey % 6 <> 0", "===="),
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPEC = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {c} THEN replace(replace({_quoted(line)}, '{{m}}', CASE WHEN p_partkey % 11 = 0 THEN 'MCCore' ELSE 'Mod' END), '{{k}}', p_partkey::VARCHAR) END" for c, line in LINES) + ")"
S = f"s AS (SELECT p_partkey AS id, p_name, p_type, {SPEC} AS spec FROM part)"


def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 11 == 0, "MCCore").otherwise("Mod")
    lines = [F.when(F.expr(c.replace("true", "true")), F.replace(F.replace(F.lit(line), F.lit("{m}"), name), F.lit("{k}"), F.col("p_partkey").cast("string"))) for c, line in LINES]
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"))
    return parts.select(F.col("p_partkey").alias("id"), "p_name", "p_type", F.concat_ws("\n", *lines).alias("spec"))


def _any(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(spec, {_quoted(pattern)}) THEN 1 ELSE 0 END"


RICH = " + ".join(_any(p) for p in scores.RICH_PATTERNS)
STRUCTURE = " + ".join(_any(p) for p in (r"----\s*MODULE\s+\w+\s*----", r"EXTENDS\s+\w+", r"VARIABLES?\s+", r"Init\s*==", r"Next\s*==", r"Spec\s*==", r"TypeOK\s*==", "===="))
COMPLEX = " + ".join(_any(p) for p in (r"\\E\b|\\A\b", "SUBSET", r"\[.*->.*\]", "Sequences", "WF_|SF_", r"CONSTANT\s+\w+.*\n.*CONSTANT|CONSTANTS", "RECURSIVE|INSTANCE|THEOREM"))
N_LINES = "len(string_split(spec, chr(10)))"


@registry.add(f"""
WITH {S}, f AS (SELECT *, {RICH} AS rich, {N_LINES} AS n FROM s),
r AS (SELECT *, CASE WHEN n BETWEEN 50 AND 500 THEN 2 WHEN n BETWEEN 20 AND 49 OR n BETWEEN 501 AND 1000 THEN 1 ELSE 0 END + {_any(scores.COMMENT_PATTERN)} + 2 * {_any(scores.INVARIANT_PATTERN)} + {_any(r'(?m)(ENABLED|<>|^\[\]|~>|WF_|SF_)')}
  + CASE WHEN rich >= 5 THEN 2 WHEN rich >= 2 THEN 1 ELSE 0 END + {_any("[a-zA-Z_][a-zA-Z0-9_]*'")} + {_any(r'[\\]E\s|[\\]A\s|∃|∀')} AS raw FROM f)
SELECT id, rich AS operator_richness, n AS line_count, raw AS raw_score, greatest(1, least(5, round_even(raw / 2.0, 0)))::INT AS overall, round(({STRUCTURE}) / 8.0, 6) AS structure,
  round(({COMPLEX} + CASE WHEN n > 40 THEN 1 ELSE 0 END + CASE WHEN n > 60 THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(spec, '(?m)^\\w+\\s*==')) >= 6 THEN 1 ELSE 0 END) / 10.0, 6) AS complexity FROM r
""")
def spec_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spec")
    q = scores.quality(s)
    return spec_table(spark, sf_dir).select("id", q["operator_richness"].alias("operator_richness"), q["line_count"].alias("line_count"), q["raw_score"].alias("raw_score"), q["overall"].alias("overall"), F.round(scores.structure(s), 6).alias("structure"), F.round(scores.complexity(s), 6).alias("complexity"))


DEFS = r"regexp_extract_all(spec, '(?m)^(\w+)\s*(?:\([^)\n]*\))?\s*==', 1)"


@registry.add(f"""
WITH {S}, d AS (SELECT id, {DEFS} AS defs, spec, regexp_extract(spec, '----\\s*MODULE\\s+(\\w+)\\s*----', 1) AS name, list_transform(string_split(regexp_extract(spec, '(?m)^EXTENDS[ \\t]+([^\\n]*)', 1), ','), lambda x: trim(x)) AS parents FROM s)
SELECT id, name, array_to_string(parents, ',') AS parents, array_to_string(defs, ',') AS defs, len(defs) <> len(list_distinct(defs)) AS duplicated, name LIKE 'MC%' AND len(name) >= 4 AS shim,
  coalesce(array_to_string(list_filter(parents, lambda p: p LIKE 'Core%'), ','), '') AS missing,
  array_to_string(regexp_extract_all(spec, '(?m)^(\\w+Inv(?:ariant)?|TypeOK|Safety\\w*)\\s*==', 1), ',') AS invariants,
  len(list_filter(string_split(spec, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '\\*') AND NOT starts_with(trim(x), '(*'))) AS code_lines
FROM d
""")
def module_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, parents, definitions, shims, missing context, invariants, code lines."""
    s, join = F.col("spec"), lambda c: F.array_join(c, ",")
    return spec_table(spark, sf_dir).select("id", modules.module_name(s).alias("name"), join(modules.extends(s)).alias("parents"), join(modules.definitions(s)).alias("defs"), modules.has_duplicate_definitions(s).alias("duplicated"), modules.is_shim(s).alias("shim"), join(modules.missing_context(s)).alias("missing"), join(modules.invariant_names(s)).alias("invariants"), modules.code_lines(s).alias("code_lines"))


@registry.add(f"""
WITH {S}, c AS (SELECT *, CASE WHEN {STRUCTURE} < 6 THEN 'bad_structure' END AS bad, {DEFS} AS defs FROM s)
SELECT coalesce(CASE WHEN spec = '' THEN 'no_spec' WHEN {N_LINES} < 8 THEN 'too_short' WHEN len(defs) <> len(list_distinct(defs)) THEN 'duplicate_ops' END, bad, CASE WHEN NOT contains(spec, '====') THEN 'parse_fail' ELSE 'kept' END) AS reason, count(*) AS n FROM c GROUP BY 1
""")
def spec_reject_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap checks before the parser hook (here its structural default)."""
    s = F.col("spec")
    early = F.when(s == "", "no_spec").when(F.size(text.lines(s)) < 8, "too_short").when(modules.has_duplicate_definitions(s), "duplicate_ops").when(scores.structure(s) < 0.75, "bad_structure")
    checked = verify.structural(spec_table(spark, sf_dir), "spec")
    return checked.select(F.coalesce(early, F.when(~F.col("valid"), "parse_fail").otherwise("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@registry.add(f"""
WITH {S}, w AS (SELECT id, CASE id % 4 WHEN 0 THEN '<think>hm</think>' || chr(10) || spec WHEN 1 THEN '```tla' || chr(10) || spec || chr(10) || '```' WHEN 2 THEN '<|channel|>analysis<|message|>x<|channel|>final<|message|>' || spec ELSE replace(spec, '\\in', '∈') END AS raw, spec FROM s)
SELECT id, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS thinks, CASE WHEN id % 4 = 1 THEN 2 ELSE 0 END AS fences, CASE WHEN id % 4 = 3 THEN len(regexp_extract_all(raw, '∈')) ELSE 0 END AS operators, 1 AS semicolons, id % 4 = 2 AS final_taken, NOT contains(spec, '====') AS terminator_added, false AS clean FROM w
""")
def normalise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewriting pipeline's counts per rule over texts that were spoilt in four ways."""
    s, k = F.col("spec"), F.col("id") % 4
    raw = F.when(k == 0, F.concat(F.lit("<think>hm</think>\n"), s)).when(k == 1, F.concat(F.lit("```tla\n"), s, F.lit("\n```"))).when(k == 2, F.concat(F.lit("<|channel|>analysis<|message|>x<|channel|>final<|message|>"), s)).otherwise(F.replace(s, F.lit("\\in"), F.lit("∈")))
    n = rewrite.normalised(raw)
    return spec_table(spark, sf_dir).select("id", *[n[c].alias(c) for c in ("thinks", "fences", "operators", "semicolons", "final_taken", "terminator_added", "clean")])


@registry.add()
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten texts themselves, after the syntax fixer's rules."""
    s = F.concat(F.lit("```\n"), F.col("spec"), F.lit("\n```"))
    out = spec_table(spark, sf_dir).select("id", rewrite.normalised(s)["text"].alias("text"))
    fixed = rewrite.fixed_syntax(F.col("text"))
    return out.select("id", fixed["text"].alias("text"), F.array_join(fixed["rules"], ",").alias("rules"))


LOG = "'Finished in 01s' || chr(10) || '<Init line 1, col 1 to line 2, col 2 of module M>: 1:1' || chr(10) || '<Next line 3, col 1 to line 4, col 2 of module M>: ' || (id % 3) || ':9' || chr(10) || '1 distinct state generated' || chr(10) || (id * 2) || ' states generated, ' || id || ' distinct states found' || CASE id % 4 WHEN 0 THEN chr(10) || 'Error: Invariant Inv is violated.' WHEN 1 THEN chr(10) || 'Deadlock reached.' ELSE chr(10) || 'No error has been found.' END"


@registry.add(f"""
WITH l AS (SELECT p_partkey AS id, {LOG.replace('id', 'p_partkey')} AS log FROM part)
SELECT id, id % 4 >= 2 AS ok, CASE WHEN id % 4 = 0 THEN 'Error: Invariant Inv is violated.' ELSE '' END AS violations, CASE WHEN id % 3 = 0 THEN 'Next' ELSE '' END AS dead, id AS distinct_states, id * 2 AS total_states,
  CASE WHEN id % 5 = 0 THEN 'syntax' WHEN id % 4 = 1 THEN 'deadlock' WHEN id % 4 = 0 THEN 'invariant_violation' ELSE 'other' END AS class FROM l
""")
def checker_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model checker prints: outcome, violations, dead actions, states (the last count), error class."""
    i = F.col("p_partkey")
    end = F.when(i % 4 == 0, "\nError: Invariant Inv is violated.").when(i % 4 == 1, "\nDeadlock reached.").otherwise("\nNo error has been found.")
    log = F.concat(F.lit("Finished in 01s\n<Init line 1, col 1 to line 2, col 2 of module M>: 1:1\n<Next line 3, col 1 to line 4, col 2 of module M>: "), (i % 3).cast("string"), F.lit(":9\n1 distinct state generated\n"), (i * 2).cast("string"), F.lit(" states generated, "), i.cast("string"), F.lit(" distinct states found"), end)
    t = table(spark, sf_dir, "part").select(i.alias("id"), log.alias("log"))
    c = F.col("log")
    states = logs.state_counts(c)
    return t.select("id", logs.check_succeeded(c).alias("ok"), F.array_join(logs.violations(c), ",").alias("violations"), F.array_join(logs.dead_actions(c), ",").alias("dead"), states["distinct"].alias("distinct_states"), states["total"].alias("total_states"), scores.error_class(F.col("id") % 5 != 0, F.lit(False), c).alias("class"))


@registry.add("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'parse_error' WHEN p_size % 3 > 0 THEN CASE WHEN p_partkey % 5 + 10 - p_size % 3 > 0 THEN 'partial' ELSE 'unproved' END WHEN p_partkey % 5 + 10 > 0 THEN 'proved' ELSE 'unproved' END AS tier,
  CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey % 5 + 10 END AS total, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey % 5 + 10 - p_size % 3 END AS proved, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size % 3 END AS failed FROM part
""")
def proof_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all summary lines of a proof checker, and the tier they give."""
    k = F.col("p_partkey") % 5
    log = F.concat(F.lit("[INFO]: All "), k.cast("string"), F.lit(" obligations proved.\n[ERROR]: "), (F.col("p_size") % 3).cast("string"), F.lit("/10 obligations failed."), F.when(F.col("p_partkey") % 9 == 0, "\nparse error").otherwise(""))
    r = logs.proof_result(F.col("log"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), log.alias("log")).select("id", r["tier"].alias("tier"), r["total"].alias("total"), r["proved"].alias("proved"), r["failed"].alias("failed"))


@registry.add(f"""
WITH {S}, l AS (SELECT id, p_name, spec, string_split(spec, chr(10)) AS lines, {DEFS} AS defs FROM s),
x AS (SELECT id, unnest(list_filter([CASE WHEN p_name <> '' THEN 'generation' END, CASE WHEN len(lines) >= 10 THEN 'completion' END, CASE WHEN regexp_matches(spec, '(?m)^(TypeOK|Inv)\\s*==') THEN 'invariant' END, CASE WHEN contains(spec, ';') THEN 'bug_fix' END], lambda t: t IS NOT NULL)) AS task FROM l)
SELECT task, count(*) AS n FROM x GROUP BY task
""")
def task_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record becomes up to four task rows; tasks it has nothing for are left out."""
    return generators.tasks(spec_table(spark, sf_dir), "id", "p_name", "spec").groupBy("task").agg(F.count("*").alias("n"))


@registry.add(f"""
WITH {S}, v AS (SELECT id, spec, CASE WHEN contains(spec, 'VARIABLES') THEN 1 ELSE 0 END AS has_v FROM s)
SELECT id, 'init' AS part, 'x = 0;' AS body FROM v UNION ALL SELECT id, 'next', CASE WHEN regexp_matches(spec, 'UNCHANGED') THEN 'x'' = x + 1 /\\ UNCHANGED queue' ELSE 'x'' = x' END FROM v WHERE contains(spec, 'Next ==')
""")
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two sub-tasks a module: its initial and its next-state relation."""
    return generators.decomposed(spec_table(spark, sf_dir), "id", "spec")


@registry.add()
def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stages a module, each with all text before it."""
    return generators.staged(spec_table(spark, sf_dir), "id", "spec")


@registry.add()
def repair_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken and whole texts by two of the mutators a module, chosen by hash; mutations that change nothing are left out."""
    return generators.mutated(spec_table(spark, sf_dir), "id", "spec", 2)


@registry.add()
def comment_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested comments, which no regular expression reads: Arrow-batched."""
    s = F.concat(F.lit("(* outer (* inner *) text *)\n(* more *)\n"), F.col("spec"))
    t = spec_table(spark, sf_dir).select("id", s.alias("spec"))
    c = F.col("spec")
    return t.select("id", F.array_join(modules.joined_comments(c), "|").alias("comments"), modules.header_comment_lines(c).alias("header"), F.length(modules.without_block_comments(c)).alias("bare"), F.array_join(modules.depth_aware_split(F.lit("a, f(b, c), {d, e}")), "|").alias("parts"))


@registry.add()
def module_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checker configurations, harness parts, type guesses."""
    s = F.col("spec")
    carved = modules.carve(s)
    return spec_table(spark, sf_dir).select("id", modules.checker_config(s).alias("config"), modules.nondeterminism(s, modules.body(s, "Next")).alias("choices"), modules.fairness(s, modules.body(s, "Spec")).alias("fairness"), F.array_join(F.transform(modules.variables(s), modules.guessed_type), ",").alias("types"), (F.concat(carved["prefix"], carved["removed"], carved["suffix"]) == s).alias("whole"), modules.trivial_invariant(s, F.array(F.lit("Inv"))).alias("trivial"))


@registry.add(f"""
WITH {S}, j AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'Next ==' || chr(10) || '  /\\ a' || chr(10) || '     /\\ b' || id || chr(10) || ' more' || chr(10) || '\\/ c' || chr(10) || spec ELSE spec END AS text,
  CASE WHEN id % 2 = 0 THEN 'Next ==' || chr(10) || '  /\\ a' || chr(10) || '  /\\ b' || id || chr(10) || ' more' || chr(10) || '  \\/ c' || chr(10) || spec ELSE spec END AS aligned FROM s)
SELECT id, length(text) AS n_before, aligned FROM j
""")
def aligned_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of junctions in one column; every other specification begins with a ragged one."""
    ragged = F.concat(F.lit("Next ==\n  /\\ a\n     /\\ b"), F.col("id").cast("string"), F.lit("\n more\n\\/ c\n"), F.col("spec"))
    t = spec_table(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, ragged).otherwise(F.col("spec")).alias("text"))
    return t.select("id", F.length("text").alias("n_before"), rewrite.indented_junctions(F.col("text")).alias("aligned"))


M, E = "---- MODULE M ----\n", "\n===="
#: One row for each rule of the fixer: id, module, the checker's message, and by hand what comes out and which rules are named.
FIXES = [
    (1, M + "(* --fair algorithm a\nbegin\nend algorithm; *)\nA == 1" + E, None, M + "\nA == 1" + E, "removed PlusCal block"),
    (2, M + "A == 1\n(* --algorithm a\nbegin x", None, M + "A == 1\n" + E, "removed incomplete PlusCal block"),
    (3, M + "A == 1\n--algorithm a\nbegin x", None, M + "A == 1\n" + E, "removed bare PlusCal algorithm block"),
    (4, M + "\\* BEGIN TRANSLATION (1)\nA == 1\n\\* END TRANSLATION" + E, None, M + "\nA == 1\n" + E, "extracted TLA+ translation from PlusCal"),
    (5, M + "A == 1\nmacro m" + E, None, M + "A == 1\n" + E, "removed PlusCal keywords"),
    (6, "```tla\n" + M + "A == 1" + E + "\n```", None, M + "A == 1" + E, "removed markdown fences"),
    (7, M + 'A == \\"it\'\'s\\"' + E, None, M + 'A == "it\'\'s"' + E, "unescaped quotes"),
    (8, M + "VARIABLES\n    x  \\* one\n    y\n    z\n\nA == 1" + E, None, M + "VARIABLES\n    x,  \\* one\n    y,\n    z\n\nA == 1" + E, "added commas to VARIABLES declaration"),
    (9, M + "CONSTANTS N \\in Nat, F \\in 1..N\n\nA == N" + E, None, M + "CONSTANTS N, F\n\nA == N" + E, "stripped inline constraints from CONSTANTS"),
    (10, M + "A == x\'\' = 1 \\* x\'\'" + E, None, M + "A == x\' = 1 \\* x\'\'" + E, "fixed double-prime to single-prime"),
    (11, M + "vars == {x, y}" + E, None, M + "vars == <<x, y>>" + E, "fixed vars set to tuple"),
    (12, M + "A == UNCHANGED x, y" + E, None, M + "A == UNCHANGED <<x, y>>" + E, "wrapped UNCHANGED multi-variable in tuple"),
    (13, M + "CONSTANT N = 5\nA == N" + E, None, M + "CONSTANT N\nA == N" + E, "removed CONSTANT value assignment"),
    (14, M + "A == x \\notin {1, 2} /\\ y \\\\in S" + E, None, M + "A == ~(x \\in {1, 2}) /\\ y \\in S" + E, "replaced \\notin with ~(\\in)"),
    (15, M + "VARIABLES x, y\n\nASSUME y > 0\nASSUME N > 0\nA == 1" + E, None, M + "VARIABLES x, y\n\n\nASSUME N > 0\nA == 1" + E, "removed ASSUME referencing variable"),
    (16, M + "ASSUME\n  N > 0\n  M > 0\nA == 1" + E, "Unknown operator in ASSUME", M + "\nA == 1" + E, "removed problematic ASSUME block"),
    (17, M + "A == 1\n", None, M + "A == 1\n" + E, "added missing ==== delimiter"),
    (18, "-- MODULE M ---\nA == 1" + E, None, M + "A == 1" + E, "fixed MODULE header dashes"),
    (19, M + "A == 1" + E + "===\nthat is all\nINVARIANT Inv\n\\* end", None, M + "A == 1" + E + "\nINVARIANT Inv\n\\* end", "cleaned after ==== (preserved TLC config)"),
    (20, M + "A ==\n  /\\ a\n\n  /\\ b" + E, None, M + "A ==\n  /\\ a\n  /\\ b" + E, ""),
    (21, M + "A ==\n  /\\ a\n    /\\ b" + E, "Item is not properly indented", M + "A ==\n  /\\ a\n  /\\ b" + E, "normalized conjunction/disjunction alignment"),
    (22, M + "EXTENDS Naturals, Foo, TLC\nA == 1" + E, None, M + "EXTENDS Naturals, TLC\nA == 1" + E, "removed unknown EXTENDS modules"),
    (23, M + "EXTENDS Foo, Bar\nA == 1" + E, None, M + "\nA == 1" + E, "removed EXTENDS with all unknown modules"),
    (24, M + "VARIABLES x, y\n\nA == UNCHANGED vars" + E, None, M + "VARIABLES x, y\n\nvars == <<x, y>>\n\n\nA == UNCHANGED vars" + E, "auto-defined vars"),
    (25, M + "VARIABLES x, y\n\nA == WF_vars(N)" + E, None, M + "VARIABLES x, y\n\nA == WF_<<x, y>>(N)" + E, "inlined vars tuple in WF/SF"),
    (26, M + "x \\in Nat\nA == 1\ny \\in Nat" + E, None, M + "A == 1\ny \\in Nat" + E, "removed bare module-level \\in expressions"),
    (27, M + 'A == EXISTS x \\in S : "EXISTS x"' + E, None, M + 'A == \\E x \\in S : "EXISTS x"' + E, "replaced EXISTS with \\E"),
    (28, M + "A == FORALL x \\in S : p (* FORALL x *)" + E, None, M + "A == \\A x \\in S : p (* FORALL x *)" + E, "replaced FORALL with \\A"),
    (29, M + "A == ALL x \\in S : p" + E, None, M + "A == \\A x \\in S : p" + E, "replaced ALL with \\A"),
    (30, M + "A == SOME x \\in S : p" + E, None, M + "A == \\E x \\in S : p" + E, "replaced SOME with \\E"),
    (31, M + "EXTENDS Naturals\nA == SUM({1})" + E, None, M + "EXTENDS Naturals" + fixer.SUM_DEFINITION + "\nA == SUM({1})" + E, "auto-defined SUM operator"),
    (32, M + "A ==\n  /\\ p\n  /\\ UNCHANGED << >>" + E, None, M + "A ==\n  /\\ p\n" + E, "removed UNCHANGED <<>> (empty tuple)"),
    (33, M + "A == [f EXCEPT ![a] = 1, [b] = 2]" + E, None, M + "A == [f EXCEPT ![a] = 1, ![b] = 2]" + E, "fixed EXCEPT missing ! before ["),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# A part's key goes into the definition A of its case, so each row's text differs.
@registry.add(f"""
SELECT p_partkey, replace(fixed, 'A ==', 'A' || p_partkey || ' ==') AS fixed, rules
FROM part JOIN (VALUES {", ".join(f"({i}, {_quoted(fixed)}, {_quoted(rules)})" for i, _, _, fixed, rules in FIXES)}) t(id, fixed, rules) ON p_partkey % {len(FIXES)} + 1 = t.id
""")
def fixed_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixer's rules over parts, one hand-made module for each rule (a few literals, broadcast)."""
    cases = spark.createDataFrame([c[:3] for c in FIXES], "id int, spec string, errors string")
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", (F.col("p_partkey") % len(FIXES) + 1).cast("int").alias("id")).join(F.broadcast(cases), "id")
    spec = F.replace("spec", F.lit("A =="), F.concat(F.lit("A"), F.col("p_partkey").cast("string"), F.lit(" ==")))
    return fixer.with_fixed(parts, spec, F.col("errors"), "f").select("p_partkey", F.col("f.text").alias("fixed"), F.array_join("f.rules", ",").alias("rules"))


FIXED_RULES = "added commas to VARIABLES declaration,fixed double-prime to single-prime,cleaned after ==== (preserved TLC config),removed unknown EXTENDS modules,replaced EXISTS with \\E"


@registry.add(f"""
WITH t AS (SELECT doc_id, replace(regexp_replace(coalesce(text, ''), '[\\n\\r\\v\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'), '\\"', '"') AS line FROM documents)
SELECT doc_id, {_quoted(M + "EXTENDS Naturals" + chr(10) + "VARIABLES" + chr(10) + "  x,  ")} || '\\* ' || line || {_quoted(chr(10) + "  y" + chr(10) + chr(10) + "(* EXISTS x'' *)" + chr(10) + "Next == " + chr(92) + "E z " + chr(92) + "in S : x' = z" + E)} AS fixed, {_quoted(FIXED_RULES)} AS rules FROM t
""")
def fixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixer over modules that hold each document's whole text as a comment: slips around it are mended, the text stays as it was."""
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r\u000B\f\u0085\u2028\u2029]+", " ")
    spec = F.concat(F.lit(M + "EXTENDS Naturals, Prose\nVARIABLES\n  x  \\* "), line, F.lit("\n  y\n\n(* EXISTS x'' *)\nNext == EXISTS z \\in S : x'' = z" + E + "\nthe end"))
    return fixer.with_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"), spec, name="f").select("doc_id", F.col("f.text").alias("fixed"), F.array_join("f.rules", ",").alias("rules"))


#: One row for each rule of the sanitiser: id, module, and by hand what comes out and which rules are named.
SANITISED = [
    (1, M + "(* --algorithm a\nbegin\nend algorithm; *)\nA == 1" + E, M + "\nA == 1" + E, "algorithm_block"),
    (2, M + "(* --spec a\nx\nend spec *)\nA == 1" + E, M + "\nA == 1" + E, "spec_block"),
    (3, M + "(* --operator Foo *)\nA == 1" + E, M + "\nA == 1" + E, "algorithm_note"),
    (4, "```tla\n" + M + "A == 1" + E, M + "A == 1" + E, "fences,module_only"),
    (5, M + "A == 1 (* open" + E, M + "A == 1 (* open *)" + E, "open_comment"),
    (6, M + "VARIABLES x\nVARIABLES y\nA == 1" + E, M + "VARIABLES x\nA == 1" + E, "one_declaration"),
    (7, M + "define\n  B == 1\nend define;\nA == 1" + E, M + "\nA == 1" + E, "define_block"),
    (8, M + "A == 1\nawait x > 0;" + E, M + "A == 1\n" + E, "statements"),
    (9, M + "variables\n  x = 1;\nA == 1" + E, M + "A == 1" + E, "local_variables"),
    (10, M + "A == 1\n  x := 2;" + E, M + "A == 1\n" + E, "assignments"),
    (11, M + "A == IF a\n  THEN b\n  ELSE c\n  else\n  skip;" + E, M + "A == IF a\n  THEN b\n  ELSE c\n\n" + E, "branches"),
    (12, M + "EXTENDS Naturals \\* n\nA == -1" + E, M + "EXTENDS Naturals, Integers \\* n\nA == -1" + E, "integers"),
    (13, M + "EXTENDS Integers\nA == (n) / 2" + E, M + "EXTENDS Integers\nA == (n) \\div 2" + E, "division"),
    (14, M + "A == RANGE f" + E, M + "A == {(f)[x] : x \\in DOMAIN f}" + E, "range_of"),
    (15, M + "CONSTANT N \\in Nat\nA == N" + E, M + "CONSTANT N\nA == N" + E, "constant_set"),
    (16, M + "CONSTANTS N, P, VARIABLES, s, t\nA == N" + E, M + "CONSTANTS N, P\nVARIABLES s, t\nA == N" + E, "constants_then_variables"),
    (17, M + "CONSTANTS\n  N, \\* size\n  P\nA == N" + E, M + "CONSTANTS N, P\nA == N" + E, "constants_on_one_line"),
    (18, M + "VARIABLES\n  s \\in [1..N -> S],\n  t\nA == N" + E, M + "VARIABLES s, t\nA == N" + E, "variables_on_one_line"),
    (19, M + "VARIABLES s = 1, t = 2\nA == N" + E, M + "VARIABLES s, t\nA == N" + E, "initial_values"),
    (20, M + "VARIABLES s \\in [1..N -> S]\nA == N" + E, M + "VARIABLES s\nA == N" + E, "variable_set"),
    (21, M + "VARIABLES x\nInit ==\n  /\\ x = 0\n  /\\ z = 0\nA == y' = x' /\\ TRUE'" + E, M + "VARIABLES x, y, z\nInit ==\n  /\\ x = 0\n  /\\ z = 0\nA == y' = x' /\\ TRUE'" + E, "variables_declared"),
    (22, M + "EXTENDS Naturals\nA == x' = 1" + E, M + "EXTENDS Naturals\nVARIABLES x\n\nA == x' = 1" + E, "variables_declared"),
    (23, M + "A == a \\neq b" + E, M + "A == a # b" + E, "not_equal"),
    (24, M + "A == a \\\\cup b" + E, M + "A == a \\cup b" + E, "double_backslash"),
    (25, M + "A == Offset()" + E, M + "A == Offset" + E, "empty_call"),
    (26, M + "A == (a bmod b) \\% c" + E, M + "A == (a % b) % c" + E, "modulo"),
    (27, M + "VARIABLES v\nA == v[i]' = 1" + E, M + "VARIABLES v\nA == v'[i] = 1" + E, "prime_before_index"),
    (28, M + "A == \\E x \\subseteq S : p" + E, M + "A == \\E x \\in SUBSET S : p" + E, "quantified_subset"),
    (29, M + "A == \\E x \\in S, y \\in f[x], z \\in U : p" + E, M + "A == \\E x \\in S : \\E y \\in f[x] : \\E z \\in U : p" + E, "nested_quantifiers"),
    (30, M + "A == [x \\in S : x + 1]" + E, M + "A == [x \\in S |-> x + 1]" + E, "function_arrow"),
    (31, M + "A ==\n  /\\ x == 1\n  /\\ LET y == 1 IN y" + E, M + "A ==\n  /\\ x = 1\n  /\\ LET y == 1 IN y" + E, "equality_in_junction"),
    (32, M + "A == Seq(S, 3)" + E, M + "A == Seq(S)" + E, "sequence_of_one"),
    (33, M + "A == Seq[S]" + E, M + "A == Seq(S)" + E, "sequence_brackets"),
    (34, M + "A == x \\in [1, N] /\\ f[a, b]" + E, M + "A == x \\in 1..N /\\ f[a, b]" + E, "range_brackets"),
    (35, M + "A == a \\subset b" + E, M + "A == a \\subseteq b" + E, "subset"),
    (36, M + "A == \\sum(S)" + E, M + "A == Sum(S)" + E, "sum"),
    (37, M + "A == \\max" + E, M + "A == Max" + E, "max_min"),
    (38, M + "A == x \\in Any" + E, M + "A == x \\in STRING" + E, "any"),
    (39, M + "A == 1\nENDIF" + E, M + "A == 1\n" + E, "endif"),
    (40, M + "A == LET y = 1 IN y" + E, M + "A == LET y == 1 IN y" + E, "let_definition"),
    (41, M + "A == \\E x \\in S\n  p" + E, M + "A == \\E x \\in S :\n  p" + E, "open_quantifier"),
    (42, M + "A == a /\\ (* note *) /\\ b" + E, M + "A == a /\\ b" + E, "double_junction"),
    (43, M + "A == Filter(q, x)" + E, M + "A == SelectSeq(q, x)" + E, "select"),
    (44, M + "A == SelectSeq(q, t' |-> t > 1)" + E, M + "VARIABLES t\n\nA == SelectSeq(q, LAMBDA t : t > 1)" + E, "variables_declared,select_lambda"),
    (45, M + "A == Max(S)" + E, M + "A == Max(S)\nMax(S) == CHOOSE x \\in S : \\A y \\in S : x >= y" + E, "helpers"),
    (46, "Here it is\n" + M + "A == 1" + E + "\nthat is all", M + "A == 1" + E, "module_only"),
    (47, M + "A == 1\nB ==\n  broken [", M + "A == 1\nB ==\n" + E, "module_only"),
    (48, M + "A == 1\n   \nB == 2" + E, M + "A == 1\n\nB == 2" + E, "blank_lines"),
]


@registry.add(f"""
SELECT p_partkey, replace(text, 'A ==', 'A' || p_partkey || ' ==') AS sanitised, rules
FROM part JOIN (VALUES {", ".join(f"({i}, {_quoted(text)}, {_quoted(rules)})" for i, _, text, rules in SANITISED)}) t(id, text, rules) ON p_partkey % {len(SANITISED)} + 1 = t.id
""")
def sanitised_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sanitiser's rules over parts, one hand-made module for each rule (a few literals, broadcast)."""
    cases = spark.createDataFrame([c[:2] for c in SANITISED], "id int, spec string")
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", (F.col("p_partkey") % len(SANITISED) + 1).cast("int").alias("id")).join(F.broadcast(cases), "id")
    spec = F.replace("spec", F.lit("A =="), F.concat(F.lit("A"), F.col("p_partkey").cast("string"), F.lit(" ==")))
    return sanitiser.with_sanitised(parts, spec, "s").select("p_partkey", F.col("s.text").alias("sanitised"), F.array_join("s.rules", ",").alias("rules"))
