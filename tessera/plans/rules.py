"""Rules over records and module texts. Each part gets one of a few awkward cases, with the part's key in its names, so the work grows with the table.

The SQL of these queries lists the rows that the rules' wording gives for a case, worked out by hand, not the rules again, so it can't repeat a mistake of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates, logs, messages, modules, scores, text
from ..operators import generators
from .registry import Registry, dealt, table

registry = Registry()

LONG = r"""---- MODULE A ----
EXTENDS Naturals
CONSTANTS N, Node
VARIABLES pc, msgs, seen
  (* note *)
TypeOK == seen \in 0..N
MyInv == TRUE
safetyInvariant == seen >= 0
  /\ TRUE

Init == seen = 0
Next == \E p \in Node : seen' = seen + 1 \/ UNCHANGED seen
Spec == Init /\ [][Next]_seen /\ WF_seen(Next)
====
"""
MODULES = [
    (1, LONG, None),
    (2, "x == 1 (* inline *)\nINVARIANT Foo\nMyInv2 == x\n", "SPECIFICATION S\nINVARIANTS Foo Bar \\* why\n"),
    (3, "INV == 1\n\\* c\n", "INIT Init\n"),
    (4, "", None),
]


def each_part(spark: SparkSession, sf_dir: str, cases: list, schema: str, *named: str) -> DataFrame:
    """p_partkey and one of the cases (numbered from 1 in their first column id; broadcast, as they are a few literals) for each part. In the columns named, the word `seen` has the part's key behind it."""
    n = max(c[0] for c in cases)
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", (F.col("p_partkey") % n + 1).cast("int").alias("id"))
    rows = parts.join(F.broadcast(spark.createDataFrame(cases, schema)), "id")
    return rows.withColumns({c: F.replace(c, F.lit("seen"), F.concat(F.lit("seen"), F.col("p_partkey").cast("string"))) for c in named})


def _expected(values: str, names: str, n: int, *named: str) -> str:
    """SQL of the rows that each_part's n cases give; the first of names is id."""
    columns = [f"replace({c}, 'seen', 'seen' || p_partkey) AS {c}" if c in named else c for c in names.split(", ")[1:]]
    return f"SELECT p_partkey, {', '.join(columns)} FROM part JOIN (VALUES {values}) t({names}) ON p_partkey % {n} + 1 = t.id"


def module_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_part(spark, sf_dir, MODULES, "id int, spec string, config string", "spec")


@registry.add(_expected("(1, true, true), (2, false, false), (3, true, true), (4, false, false)", "id, has_comments, has_invariants", 4))
def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block comments count only at the start of a line, invariants only as definitions there, whatever their case."""
    q = scores.quality(F.col("spec"))
    return module_table(spark, sf_dir).select("p_partkey", q["has_comments"].alias("has_comments"), q["has_invariants"].alias("has_invariants"))


@registry.add(_expected(r"""(1, 'TypeOK,MyInv,safetyInvariant', 'TypeOK == seen \in 0..N#safetyInvariant == seen >= 0|  /\ TRUE', true), (2, 'Foo,Bar,why', '', true), (3, '', 'INV == 1', false), (4, '', '', false)""", "id, names, blocks, found", 4, "blocks"))
def invariant_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants' names (the configuration's first) and blocks, and whether there are any names."""
    names = modules.invariant_names(F.col("spec"), F.col("config"))
    blocks = F.replace(F.array_join(modules.invariant_blocks(F.col("spec")), "#"), F.lit("\n"), F.lit("|"))
    return module_table(spark, sf_dir).select("p_partkey", F.array_join(names, ",").alias("names"), blocks.alias("blocks"), (F.size(names) > 0).alias("found"))


@registry.add(_expected("(1, 'N', '3'), (2, 'Node', '{v1, v2, v3}'), (3, 'Leader', 'v1'), (4, 'Workers', '{v1, v2, v3}'), (5, 'Foo', '3')", "id, name, value", 5))
def constant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checker values of constants: by use in the text, then by name."""
    names = each_part(spark, sf_dir, [(i, n, LONG) for i, n in enumerate(("N", "Node", "Leader", "Workers", "Foo"), 1)], "id int, name string, spec string", "spec")
    return names.select("p_partkey", "name", modules.constant_value(F.col("name"), F.col("spec")).alias("value"))


@registry.add(_expected("(1, 'pcs', '[control / process state]'), (2, 'self', '[control / process state]'), (3, 'Msgs', '[message/channel component]'), (4, 'votes', '[set or sequence component]'), (5, 'vars', '[state function / data value]'), (6, 'clock', '[state function / data value]')", "id, name, kind", 6))
def variable_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = each_part(spark, sf_dir, list(enumerate(("pcs", "self", "Msgs", "votes", "vars", "clock"), 1)), "id int, name string")
    return names.select("p_partkey", "name", modules.guessed_type(F.col("name")).alias("kind"))


@registry.add(_expected(r"""
  (1, 'existential quantification (\E) chooses a witness (e.g. process or schedule step). disjunction (\/) combines alternative transitions.', 'Weak fairness (WF_) on action(s).'),
  (2, 'No explicit \E/CHOOSE detected in scanned Next/spec fragment; may be deterministic or use library ops.', 'No WF_/SF_ tokens found in Spec fragment; liveness may be absent or expressed differently.')""", "id, choices, fairness", 4))
def behaviour_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spec")
    return module_table(spark, sf_dir).filter("id < 3").select("p_partkey", modules.nondeterminism(s, modules.body(s, "Next")).alias("choices"), modules.fairness(s, modules.body(s, "Spec")).alias("fairness"))


@registry.add(_expected("(1, 'tuned:8b-seen', 'fine-tuned'), (2, 'tuned', 'general'), (3, 'gpt-oss:20b', 'base'), (4, 'llama-seen', 'general')", "id, model, class", 4, "model"))
def model_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = each_part(spark, sf_dir, list(enumerate(("tuned:8b-seen", "tuned", "gpt-oss:20b", "llama-seen"), 1)), "id int, model string", "model")
    return names.select("p_partkey", "model", scores.model_class(F.col("model"), "tuned").alias("class"))


@registry.add(_expected("(1, 3, 1e0), (2, 0, 0e0), (3, 0, 0e0), (4, 0, 0e0)", "id, named, structure", 4))
def expected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of four expected names are defined, and the structure score that asks for one of them."""
    want = F.array(*map(F.lit, ("TypeOK", "Init", "Seen", "MyInv")))
    return module_table(spark, sf_dir).select("p_partkey", scores.expected_overlap(F.col("spec"), want).alias("named"), F.round(scores.structure_with(F.col("spec"), want), 6).alias("structure"))


@registry.add(_expected("(1, true, false), (2, false, true), (3, false, true), (4, false, true)", "id, core, stub", 4))
def module_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_table(spark, sf_dir).select("p_partkey", gates.core_structure(F.col("spec")).alias("core"), gates.is_stub(F.col("spec")).alias("stub"))


@registry.add(_expected("(1, true, true, true, true, true, true), (2, true, true, false, false, false, false), (3, false, false, true, false, false, false)", "id, tier_ok, credit_ok, short, in_band, reasoned, annotated", 3))
def record_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, credit floor, budget of characters, headroom, reasoning and annotation, on rows at the limits and with nulls."""
    rows = [(1, "gold", 0.5, "aaaa", "bb", "ccccc", 0.4, "x" * 200, "good"), (2, "silver", None, "a" * 6, "bbbb", "", 0.05, "x" * 199, "[annotation failed: x"), (3, "bronze", 0.1, None, None, "cc", None, None, None)]
    c = F.col
    return each_part(spark, sf_dir, rows, "id int, tier string, credit double, p string, c string, r string, score double, reasoning string, note string").select(
        "p_partkey", gates.tier_allowed(c("tier")).alias("tier_ok"), gates.credit_floor(c("credit"), 0.3).alias("credit_ok"), gates.within_budget(c("p"), c("c"), c("r"), 9).alias("short"), gates.headroom(c("score"), 0.1, 0.4).alias("in_band"), gates.reasoned(c("reasoning")).alias("reasoned"), gates.annotated(c("note")).alias("annotated")
    )


@registry.add("""
SELECT name, n, n >= least AS enough FROM (SELECT 'labels' AS name, count(*) AS n, 200 AS least FROM labels UNION ALL SELECT 'regions', count(*), 200 FROM region UNION ALL SELECT 'documents', count(*), 4 FROM documents)
""")
def row_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts held against the least that training needs."""
    least = {"labels": ("labels", 200), "regions": ("region", 200), "documents": ("documents", 4)}
    out = None
    for name, (t, k) in least.items():
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") >= k).alias("enough"))
        out = one if out is None else out.union(one)
    return out


SHORT = "VARIABLE q\nTypeOK == q \\in Nat\n\n\\* start\nInit == q = 0\n  /\\ TRUE\n\n\\* step\n(* more *)\nNext == q' = q\n\n==== \n\\* tail"


def _sql(text: str) -> str:
    return "'" + text.strip().replace("\n", "|").replace("'", "''") + "'"


@registry.add(_expected(rf"""
  (1, 'full_gen', {_sql(LONG)}), (2, 'full_gen', {_sql(MODULES[1][1])}), (3, 'full_gen', {_sql(MODULES[2][1])}), (5, 'full_gen', {_sql(SHORT)}),
  (1, 'completion', 'Next == \E p \in Node : seen'' = seen + 1 \/ UNCHANGED seen|Spec == Init /\ [][Next]_seen /\ WF_seen(Next)|===='),
  (1, 'infill_next', 'Next == \E p \in Node : seen'' = seen + 1 \/ UNCHANGED seen'),
  (1, 'segment_init', 'Init == seen = 0'),
  (1, 'req_analysis', '**Required properties for this system:**||- `TypeOK` — Type OK|- `MyInv` — My Inv|- `safetyInvariant` — safety Invariant'),
  (5, 'completion', '\* step|(* more *)|Next == q'' = q||==== |\* tail'),
  (5, 'infill_next', 'Next == q'' = q'),
  (5, 'segment_init', 'Init == q = 0|  /\ TRUE'),
  (5, 'req_analysis', '**Required properties for this system:**||- `TypeOK` — Type OK')""", "id, task, answer", 7, "answer"))
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module's rows of five task types. Comments before a definition belong to it; repeated rows count once, rows without a description give none."""
    more = [(5, SHORT, "a queue"), (5, SHORT, "a queue"), (6, SHORT, None), (7, SHORT, " ")]
    rows = each_part(spark, sf_dir, [(i, s, "a queue") for i, s, _ in MODULES] + more, "id int, spec string, description string", "spec")
    return generators.multitask(rows, "p_partkey", "description", "spec").select("p_partkey", "task", F.replace(F.col("messages")[1]["content"], F.lit("\n"), F.lit("|")).alias("answer"))


@registry.add(_expected("(1, 'bad_keyword', -6, true), (1, 'double_prime', 1, true), (1, 'pluscal_leak', 6, true), (1, 'remove_closing', -4, true), (1, 'remove_extends', -16, true)", "id, mutation, longer, messaged", 4))
def syntax_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven syntax errors tried on each module: what changes a text becomes a repair row, short modules give none."""
    rows = generators.syntax_repairs(module_table(spark, sf_dir), "p_partkey", "spec", len(generators.SYNTAX_ERRORS))
    return rows.select("p_partkey", "mutation", (F.length("broken") - F.length("fixed")).alias("longer"), (F.size("messages") == 2).alias("messaged"))


@registry.add("""
SELECT CASE WHEN event_id % 3 = 0 THEN 'generalisation' ELSE 'memorisation' END AS phase, count(*) AS n, count(*) FILTER (WHERE value > 2) AS parsed, count(*) FILTER (WHERE value > 5) AS checked,
  count(*) FILTER (WHERE value > 8) AS gold, count(*) FILTER (WHERE value > 5 AND value <= 8) AS silver, count(*) FILTER (WHERE NOT value > 5) AS bronze FROM events GROUP BY 1
""")
def two_phase_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes and tiers of an evaluation's two phases, in one pass."""
    phase = F.when(F.col("event_id") % 3 == 0, "generalisation").otherwise("memorisation")
    tier = F.when(F.col("value") > 8, "gold").when(F.col("value") > 5, "silver").when(~(F.col("value") > 5), "bronze")
    e = table(spark, sf_dir, "events").select(phase.alias("phase"), "value", tier.alias("tier"))
    return e.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 2).alias("parsed"), F.count_if(F.col("value") > 5).alias("checked"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("gold", "silver", "bronze")])


@registry.add("""
WITH r AS (SELECT p_size % 2 AS suite, p_partkey % 9 <> 0 AS parsed, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_partkey % 5 + 10 - p_size % 3 END AS proved, p_partkey % 6 + 8 AS wanted FROM part)
SELECT suite, count(*) AS n, round(avg(parsed::INT), 6) AS parse_rate, round(avg((proved > 0)::INT), 6) AS any_proved, round(avg((proved >= wanted)::INT), 6) AS full_proved, round(avg(proved), 6) AS mean_proved FROM r GROUP BY suite
""")
def proof_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of proof logs: parsed, anything proved, all that the gold proof has proved, and mean obligations."""
    k = F.col("p_partkey")
    log = F.concat(F.lit("[INFO]: All "), (k % 5).cast("string"), F.lit(" obligations proved.\n[ERROR]: "), (F.col("p_size") % 3).cast("string"), F.lit("/10 obligations failed."), F.when(k % 9 == 0, "\nparse error").otherwise(""))
    r = table(spark, sf_dir, "part").select((F.col("p_size") % 2).alias("suite"), (k % 6 + 8).alias("wanted"), logs.proof_result(log).alias("r"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    proved = F.col("r.proved")
    return r.groupBy("suite").agg(F.count("*").alias("n"), rate(F.col("r.tier") != "parse_error").alias("parse_rate"), rate(proved > 0).alias("any_proved"), rate(proved >= F.col("wanted")).alias("full_proved"), F.round(F.avg(proved), 6).alias("mean_proved"))


@registry.add(_expected("(1, 'ok', ''), (2, 'violation', ''), (3, 'error', 'Error: seen|Type checker says no'), (4, 'error', '')", "id, outcome, errors", 4, "errors"))
def bounded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bounded checker's log says."""
    rows = [(1, "a line\nEXITCODE: OK\n"), (2, "Error: Inv is VIOLATED\nEXITCODE: ERROR (12)"), (3, "first error\n  Error: seen\nType checker says no\n"), (4, "")]
    r = logs.bounded_result(F.col("log"))
    return each_part(spark, sf_dir, rows, "id int, log string", "log").select("p_partkey", r["outcome"].alias("outcome"), F.array_join(r["errors"], "|").alias("errors"))


@registry.add(_expected("(1, 'Define the operator or extend the module that has it.'), (2, 'Check the line''s brackets and junctions.|Define each name once.'), (3, '')", "id, hints", 3))
def parser_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Unknown operator: `Foo'"), (2, "Was expecting \"==\"\nMultiple declarations of x"), (3, "fine")]
    return each_part(spark, sf_dir, rows, "id int, log string").select("p_partkey", F.array_join(logs.hints(F.col("log")), "|").alias("hints"))


@registry.add("""
WITH c AS (SELECT conv_id, arg_min(CASE conv_id % 3 WHEN 0 THEN 'Please FIX THE SPEC now. ' WHEN 1 THEN 'It has Syntax  errors ' ELSE '' END || text, turn) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(contains(lower(asked), 'fix the spec') OR contains(lower(asked), 'syntax errors') OR contains(lower(asked), 'sany errors'), false) AS repair FROM c
""")
def repair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation's first user message asks for a repair; a third of them are made to, and a third nearly."""
    lead = F.when(F.col("conv_id") % 3 == 0, "Please FIX THE SPEC now. ").when(F.col("conv_id") % 3 == 1, "It has Syntax  errors ").otherwise("")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.concat(lead, "text").alias("content")))).alias("turns"))
    chat = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.lit(None).cast("string").alias("channel"), t["content"].alias("content")))
    return turns.select("conv_id", messages.is_repair_request(chat).alias("repair"))


@registry.add(_expected("(1, true, 1e0), (2, false, 6e-1), (3, false, 2e-1), (4, false, 0e0)", "id, diamond, semantic", 4))
def diamond_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top tier's gate, and the composite of coverage (0.4), any invariant (0.4) and a caught mutation (0.2)."""
    rows = [(1, 5, False, 2, True, True, 1.0), (2, 1, False, 1, True, True, 0.0), (3, 9, False, 0, True, True, 0.0), (4, 9, True, 0, False, False, 0.0)]
    c = F.col
    t = each_part(spark, sf_dir, rows, "id int, states int, trivial boolean, invariants int, tested boolean, caught boolean, coverage double")
    return t.select("p_partkey", scores.is_diamond(c("states"), c("trivial"), c("invariants"), c("tested"), c("caught")).alias("diamond"), F.round(scores.semantic_score(c("coverage"), c("invariants"), c("caught")), 6).alias("semantic"))


SPLIT = "---- MODULE A ----\nx == seen\n====\nSPECIFICATION Spec\n\nINVARIANT Inv\n"


@registry.add(_expected("(1, '---- MODULE A ----|x == seen|====', 'SPECIFICATION Spec|INVARIANT Inv'), (2, '---- MODULE A ----|====|seen text', NULL), (3, 'seen', NULL)", "id, spec, config", 3, "spec"))
def inline_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration behind the terminator is cut off; other text there stays."""
    rows = each_part(spark, sf_dir, [(1, SPLIT), (2, "---- MODULE A ----\n====\nseen text"), (3, "seen")], "id int, text string", "text")
    r = modules.inline_config(F.col("text"))
    line = lambda c: F.replace(c, F.lit("\n"), F.lit("|"))
    return rows.select("p_partkey", line(r["spec"]).alias("spec"), line(r["config"]).alias("config"))


@registry.add(_expected("(1, 'FooBar,Foo'), (2, ''), (3, 'Aa,Ab')", "id, names", 3))
def called_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a body uses as whole words, longest first, then by name."""
    rows = each_part(spark, sf_dir, [(1, "Foo(x) + FooBar + seen"), (2, "Foos BarFoo"), (3, "Ab /\\ Aa /\\ Ab")], "id int, body string", "body")
    names = F.array(*map(F.lit, ("Ab", "Foo", "FooBar", "Bar", "Aa")))
    return rows.select("p_partkey", F.array_join(modules.called(F.col("body"), names), ",").alias("names"))


@registry.add(_expected("(1, 'seen/dir'), (2, 'repo:seen'), (3, NULL), (4, 'a')", "id, family", 4, "family"))
def module_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of a module's file, else its source without the last part, else none."""
    rows = each_part(spark, sf_dir, [(1, "repo:x:M", "seen/dir/M.tla"), (2, "repo:seen:M", None), (3, "plain", "M.tla"), (4, None, "a/M.tla")], "id int, source string, path string", "source", "path")
    return rows.select("p_partkey", modules.family(F.col("source"), F.col("path")).alias("family"))


@registry.add(_expected("(1, '---- MODULE Mseen ----|EXTENDS Naturals|Init == x = 0|===='), (2, '---- MODULE Mseen ----|Init == y|Next == z|====')", "id, text", 2, "text"))
def assembled_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules put together from their pieces; empty and null pieces are left out."""
    rows = each_part(spark, sf_dir, [(1, "Mseen", "Naturals", "x = 0", " "), (2, "Mseen", None, "y", "z")], "id int, name string, parents string, init string, next string", "name")
    whole = modules.assembled(F.col("name"), {"EXTENDS": F.col("parents"), "Init": F.col("init"), "Next": F.col("next")})
    return rows.select("p_partkey", F.replace(whole, F.lit("\n"), F.lit("|")).alias("text"))


@registry.add("""SELECT p_partkey, substr(md5('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'), 1, 8) AS fingerprint FROM part""")
def config_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight hex digits that stand for a row's settings, whatever the order of their names."""
    return table(spark, sf_dir, "part").select("p_partkey", text.config_fingerprint("p_size", "p_brand").alias("fingerprint"))


@registry.add("SELECT source, count(*) AS n, count(*) >= 3 AS enough FROM documents GROUP BY source HAVING count(*) > 0")
def required_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, behind a gate that ends the job where the table has too few rows."""
    docs = gates.require_rows(table(spark, sf_dir, "documents"), 2, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), (F.count("*") >= 3).alias("enough"))
