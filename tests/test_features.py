"""Training rows, feedback, rewards, junctions, counters, newest files and band layouts on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import logs, rewards, rewrite
from tessera.operators import dedup, training
from tessera.sources import files, sinks

SCHEMA = "cycle long, prompt_id string, position long, prompt_text string, spec string, tier string, is_diamond boolean, timed_out boolean, parsed boolean, violations array<string>, log string, repair_from string, repair_violations array<string>, repair_type string"


def result(cycle, prompt, position, tier, diamond=False, timed_out=False, parsed=True, violations=(), log="", repair=None):
    return (cycle, prompt, position, f"about {prompt}", f" spec {cycle}{prompt}{position} ", tier, diamond, timed_out, parsed, list(violations), log, *(repair or (None, None, None)))


def test_training_rows_by_hand(spark):
    rows = [
        result(0, "p", 1, "silver", violations=["Error: a", "Invariant Inv is violated"], log="Invariant Inv is violated"), result(0, "p", 2, "gold"), result(0, "p", 3, "gold", diamond=True),
        result(0, "q", 1, "gold"), result(0, "q", 2, "gold", repair=(" old ", ["E1", "TLC_TIMEOUT x", "E2"], "sany")), result(0, "q", 3, "bronze", parsed=False),
        result(1, "q", 1, "bronze", parsed=False), result(1, "q", 2, "silver", violations=["Error: z"]), result(1, "r", 1, "silver", timed_out=True, violations=["Error: y"]), result(1, None, 1, None),
        result(2, "p", 1, "bronze", parsed=False), result(2, "r", 1, "gold", repair=("old r", ["TLC_TIMEOUT"], "tlc")),
    ]
    out = training.training_rows(spark.createDataFrame(rows, SCHEMA), developer="D").collect()
    got = sorted((r.cycle, r.row_id, r.kind, r.tier, r.messages[3].content if r.messages else r.chosen, r.rejected) for r in out)
    assert got == sorted([
        (0, "p", "sft", "diamond", "spec 0p3", None), (0, "p", "dpo", "diamond", "spec 0p3", "spec 0p1"), (0, "p_bugfix", "sft", "bugfix", "spec 0p3", None),
        (0, "q", "sft", "gold", "spec 0q1", None), (0, "q_bugfix", "sft", "bugfix", "spec 0q1", None), (0, "q_sany_repair", "sft", "sany_repair", "spec 0q2", None), (0, "q", "dpo", "sany_repair", "spec 0q2", "old"),
        (1, "q_xcycle", "sft", "cross_cycle_bugfix", "spec 0q2", None), (2, "p_xcycle_syn", "sft", "cross_cycle_syntax", "spec 0p3", None),
        (2, "r", "sft", "gold", "spec 2r1", None), (2, "r_rlvr", "sft", "rlvr_repair", "spec 2r1", None), (2, "r", "dpo", "rlvr_repair", "spec 2r1", "old r"),
    ], key=lambda r: r)
    by = {(r.row_id, r.kind): r for r in out}
    assert by["q_sany_repair", "sft"].messages[1].content == training.SYNTAX_ERRORS + "E1\nE2\n\nBroken spec:\nold\n\nFix ALL syntax errors and produce a correct spec."
    assert by["p", "dpo"].feedback == "Error: a\nInvariant Inv is violated" and by["p", "sft"].messages[0].content == "D"
    assert by["p_bugfix", "sft"].messages[1].content.startswith(training.MODEL_ERRORS + "INVARIANT VIOLATION: Inv was violated.\nTLC ERROR: Error: a\n\nBuggy spec:\nspec 0p1")
    assert training.training_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_examples_and_cache_keep_the_first(spark):
    df = spark.createDataFrame([result(0, "p", 1, "gold"), result(0, "p", 2, "gold"), result(1, "p", 1, "gold"), result(1, "s", 1, "gold"), result(1, "t", 1, "silver")], SCHEMA)
    cache = training.insert_if_absent(training.gold_cache(df.filter("cycle = 0")), df.filter("cycle = 1"))
    assert sorted(map(tuple, cache.collect())) == [("p", 0, "spec 0p2"), ("s", 1, "spec 1s1")]
    rows = training.training_rows(df)
    assert training.new_examples(rows, rows.filter("cycle = 0")).select("row_id").collect() == [("p",), ("s",)] or training.new_examples(rows, rows.filter("cycle = 0")).count() == 2
    assert training.new_examples(rows.union(rows)).count() == rows.filter("kind = 'sft'").count()


def test_feedback(spark):
    log = "x\nInvariant Safe is violated.\nError: The behavior up to this point is:\nState 1: <Init>\n/\\ a = 1\n\nnoise\n-> State 2\n  /\\ a = 2\n12 states generated\n/\\ late\nError evaluating f\nsecond line\n\nSet is not enumerable; CONSTANT N is not assigned"
    got = spark.createDataFrame([(log, ["Error: e", "Safe is violated: error"]), ("", []), (None, [])], "log string, v array<string>").select(logs.feedback(F.col("log"), F.col("v")).alias("f")).collect()
    assert got[0].f.split("\n") == ["INVARIANT VIOLATION: Safe was violated.", logs.TRACE, "  State 1: <Init>", "  /\\ a = 1", "  -> State 2", "  /\\ a = 2", "TLC ERROR: Error: e", "EVALUATION ERROR: Error evaluating f", "second line", logs.NOT_ENUMERABLE, logs.NOT_ASSIGNED]
    assert got[1].f == got[2].f == ""


def brute_junctions(text):
    lines, out, column = text.split("\n"), [], None
    junction = lambda x: re.match(r"\s*(/\\|\\/)", x)
    for i, line in enumerate(lines):
        if column is not None and junction(line):
            out.append(column + line.lstrip())
            continue
        if column is None or not re.match(r"\s+\S", line) or re.match(r"\s*(ELSE|IN|THEN|LET|IF|CASE|OTHER)\b", line):
            after = lines[i + 1] if i + 1 < len(lines) else ""
            column = re.match(r"\s*", after)[0] if junction(after) else None
        out.append(line)
    return "\n".join(out)


TEXTS = ["", "a", "Init ==\n  /\\ a\n    /\\ b\n \\/ c\n\nNext == x", "A ==\n /\\ x\n      more\n   /\\ y\n  IF z\n     /\\ w\n  /\\ v", "/\\ a\n   /\\ b\n/\\ c", "B == \\/ 1\n     \\/ 2\n  \\/ 3\nC == 1\n\t/\\ t\n /\\ u\n"]


def test_junctions(spark):
    texts = [*TEXTS, "\n".join(TEXTS * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", rewrite.indented_junctions(F.col("t")).alias("u")).collect()}
    assert got == {i: brute_junctions(t) for i, t in enumerate(texts)}
    again = spark.createDataFrame(list(got.items()), "i int, t string").select("i", rewrite.indented_junctions(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in again} == got


def test_rewards_of_mixed_shapes(spark):
    shapes = ['"plain text"', '[{"role": "assistant", "content": "in "}, {"role": "assistant", "content": "parts"}, {"role": "x"}]', "[]", '""', "17", None, '"  "', '"fails"']
    df = spark.createDataFrame(list(enumerate(shapes)), "i int, j string").select("i", rewards.completion_text(F.parse_json("j")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == ["plain text", "in parts", "", "", "17", "", "  ", "fails"]

    def grade(prompt, completion):
        if completion == "fails":
            raise RuntimeError("no grade")
        return len(completion) / 10

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = df.repartition(2).select("i", rewards.reward(rewards.one_by_one(grade), F.lit(None).cast("string"), F.col("t")).alias("r")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.i: r.r for r in got} == {0: 1.0, 1: 0.8, 2: 0.0, 3: 0.0, 4: 0.2, 5: 0.0, 6: 0.0, 7: 0.0}
    assert df.limit(0).select(rewards.reward(rewards.one_by_one(grade), F.col("t"), F.col("t"))).count() == 0


def test_counters_are_observed_in_the_writing_pass(spark, tmp_path):
    out = sinks.write_counted(spark.range(100), f"{tmp_path}/rows", f"{tmp_path}/log", 7, n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0), none=F.sum(F.when(F.col("id") < 0, 1)))
    assert out == {"n": 100, "even": 50, "none": 0} and spark.read.parquet(f"{tmp_path}/rows").count() == 100
    sinks.write_counted(spark.range(3).limit(0), f"{tmp_path}/rows2", f"{tmp_path}/log", 8, n=F.count("*"))
    assert sorted((r.step, r.counter, r.n) for r in spark.read.json(f"{tmp_path}/log").collect()) == [(7, "even", 50), (7, "n", 100), (7, "none", 0), (8, "n", 0)]


def test_newest_file(spark, tmp_path):
    import os

    for name, body, at in (("a.csv", "x\n1\n2\n", 100), ("b.csv", "x\n3\n", 200), ("c.csv", "x\n4\n", 200), ("d.csv", "x\n", 300), ("e.txt", "x\n9\n", 400)):
        (tmp_path / name).write_text(body)
        os.utime(tmp_path / name, (at, at))
    got = files.newest_file(spark, str(tmp_path), "x int", header=True).collect()
    assert [(r.x, r.source.rsplit("/", 1)[1]) for r in got] == [(3, "b.csv")]
    for name in "abc":
        os.remove(tmp_path / f"{name}.csv")
    assert files.newest_file(spark, str(tmp_path), "x int", header=True).collect() == []


def test_band_layout():
    for threshold, recall in ((0.8, 0.95), (0.8, 0.5), (0.5, 0.99), (0.95, 0.999)):
        bands, rows = dedup.band_layout(threshold, recall)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= recall
        more = 128 // (rows + 1)
        assert 1 - (1 - threshold ** (rows + 1)) ** more < recall
    with pytest.raises(ValueError):
        dedup.band_layout(0.01, 0.9999, 4)


def test_links_found_by_bands(spark):
    """Recall of links, not of documents."""
    from tessera.plans import catalogue

    r = catalogue.queries()["near_dup_lsh_recall"](spark, "/root/testdata/sf0.01").first()
    assert r.linked > 50 and r.found >= 0.9 * r.linked


def test_long_list_of_junctions(spark):
    text = "A ==\n" + "  /\\ x\n   /\\ y\n" * 20_000
    out = spark.createDataFrame([(text,)], "t string").select(rewrite.indented_junctions(F.col("t")).alias("u")).first().u
    assert out == brute_junctions(text)


def test_leaks_of_items_of_all_lengths(spark):
    """Long, short and one- and two-word items, in the middle of words too, against plain containment."""
    from tessera.plans.corpus import _leaks

    items = [(1, "a b c d e f g h i j"), (2, "one two  three four"), (3, "x y z"), (4, "solo"), (5, "two words"), (6, "a b c d e f g h i"), (7, "b  c d\te f g h i j k")]
    texts = ["za b c d e f g h i jz", "someone two  three fours", "one two three four", "ax y zb", "consolor", "two wordsmith", "b  c d\te f g h i j kk", "", None, "a b c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i) for d, t in enumerate(texts) if t for i, item in items if item in t}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) >= 7
    assert _leaks(docs, spark.createDataFrame(items[:1], "item_id long, text string").limit(0)).count() == 0


def test_gate_ends_the_job(spark):
    from tessera.functions import gates

    assert gates.require_rows(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="4 rows, 5 are needed"):
        gates.require_rows(spark.range(4), 5)
