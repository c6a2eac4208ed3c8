"""Sources, sinks and streams on small folders."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.plans import streams as stream_queries
from tessera.sources import files, sinks
from tessera.streaming import streams
from tests.test_functions import written


def test_json_lines_modes(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "x"}\n\n{bad\n{"id": 2}\n')
    schema = "id long, t string"
    assert sorted(r.id for r in files.json_lines(spark, str(p), schema, "drop").collect()) == [1, 2]
    counts = files.malformed(files.json_lines(spark, str(p), schema, "keep")).first()
    assert (counts.good, counts.bad) == (2, 1)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(p), schema).collect()


def test_records_lack_members(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"id": "a", "result": {"tier": "gold"}, "messages": {"t": [{"role": "user", "content": "c"}]}, "extra": 1}\n{"id": "b"}\n')
    got = {r.id: r for r in files.records(spark, str(p)).collect()}
    assert got["a"].result.tier == "gold" and got["a"].messages["t"][0].channel is None and got["b"].result is None


def test_csv_names_and_drift(spark, tmp_path):
    (tmp_path / "r_c7_20260101_020304.csv").write_text('a,b\n1,"x ""q""\ny"\nbad,z\n,w\n')
    (tmp_path / "r_c8_x.csv").write_text("later,a\nq,5\n")
    df = files.csv_strings(spark, str(tmp_path), ["a", "b", "later"])
    assert [tuple(r) for r in df.filter("cycle = 8").select("a", "b", "later", "written").collect()] == [("5", None, "q", None)]
    df = df.filter("cycle = 7")
    rows = sorted((r.a, r.b, r.later, r.cycle, str(r.written)) for r in files.typed(df, ["a"]).collect())
    assert rows == [(0, "w", None, 7, "2026-01-01 02:03:04"), (1, 'x "q"\ny', None, 7, "2026-01-01 02:03:04")]


def test_state_or_nothing(spark, tmp_path):
    assert files.state(spark, str(tmp_path / "none"), "k string").count() == 0
    sinks.once(spark.range(3), str(tmp_path / "s"))
    sinks.once(spark.range(9), str(tmp_path / "s"))
    assert files.state(spark, str(tmp_path / "s"), "id long").count() == 3


def test_replace_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(2), path)
    sinks.replace(spark.range(5), path)
    assert (spark.read.parquet(path).count(), spark.read.parquet(path + ".backup").count()) == (5, 2)


def test_small_reports(spark, tmp_path):
    assert sinks.text_table([["a", 1]], ["k", "value"]).splitlines()[2] == "a  1"
    assert sinks.bundle(x=spark.range(2), y=spark.range(1)).first()[0] == '{"x":[{"id":0},{"id":1}],"y":[{"id":0}]}'
    sinks.summary(spark.range(4), str(tmp_path / "sum"), seed=1)
    assert spark.read.json(str(tmp_path / "sum")).first().rows == 4


def test_append_log_goes_on(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in (spark.range(0, 5), spark.range(5, 9)):
        part.write.mode("append").parquet(src)
        streams.append_log(streams.file_stream(spark, src, "id long"), out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(9))


def test_near_copies_of_later_batches_go(spark, tmp_path):
    kept, source = str(tmp_path / "kept"), str(tmp_path / "in")
    words = [f"w{i}" for i in range(20)]
    a, b, c = " ".join(words), " ".join([*words[1:], "x"]), " ".join(f"v{i}" for i in range(20))
    for rows in ([(1, a), (2, b), (3, "lone"), (8, ""), (9, None)], [(4, b), (5, c), (6, c + " y"), (7, a.upper()), (10, "")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = streams.file_stream(spark, source, "doc_id long, text string", 10)
        stream.writeStream.foreachBatch(streams.dedup_against(kept)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.doc_id for r in streams.kept_rows(spark, kept).collect()) == [1, 3, 5, 8, 9, 10]


def test_repeated_batches_change_nothing(spark, tmp_path):
    kept = str(tmp_path / "kept")
    step = streams.dedup_against(kept)
    batches = [spark.createDataFrame(rows, "doc_id long, text string, batch_name string") for rows in ([], [(1, "a b c d e", "x"), (2, "e d c b a", "x")], [(3, "a b c d e", "y"), (4, "f g", "y")], [(5, "g f", "z"), (6, "h", "z")])]
    for number, batch in [*enumerate(batches), (1, batches[1]), (3, batches[3]), (2, batches[2])]:
        step(batch, number)
        if number == 3:
            assert sorted(r.doc_id for r in streams.kept_rows(spark, kept).collect()) == [1, 4, 6]
    got = streams.kept_rows(spark, kept)
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 6] and got.columns == ["doc_id", "text", "batch_name"]


def test_words_that_later_batches_repeat_keep_the_order(spark, tmp_path):
    """No word comes twice in the first batch; in the second half of each row's do, beside a near copy of the row."""
    kept = str(tmp_path / "kept")
    step = streams.dedup_against(kept)
    words = [[f"f{k}w{i}" for i in range(10)] for k in range(40)]
    copies = [(100 + k, " ".join([*w[:9], f"x{k}"])) for k, w in enumerate(words)]
    others = [(1000 + 10 * k + i, f"{w} {w}a {w}b") for k, own in enumerate(words) for i, w in enumerate(own[:5])]
    for i, rows in enumerate(([(k, " ".join(w)) for k, w in enumerate(words)], copies + others)):
        step(spark.createDataFrame(rows, "doc_id long, text string"), i)
    assert sorted(r.doc_id for r in streams.kept_rows(spark, kept).collect()) == [*range(40), *(i for i, _ in others)]


def test_near_index_moves_a_set_once_for_many_pairs(spark, tmp_path):
    rnd = random.Random(5)
    words = [f"{rnd.getrandbits(64):x}" for _ in range(1500)]
    texts = [" ".join(w for w in words if rnd.random() < 0.95) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").checkpoint()
    step = streams.dedup_against(str(tmp_path / "kept"))
    before, bound = written(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        step(df, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert [r.doc_id for r in streams.kept_rows(spark, str(tmp_path / "kept")).collect()] == [0]
    assert written(spark) - before < 3 * sum(map(len, texts))


def test_parts_of_a_stream_are_written_by_all_tasks(spark, tmp_path):
    """Each part is a batch, however many files it has."""
    seen = []
    for part in stream_queries._in_parts(spark.range(0, 100, 1, 4), [32, 65], "id"):
        step = lambda batch, number: seen.append((number, sorted(r.id for r in batch.collect()), batch.select(F.input_file_name()).distinct().count()))
        part.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, list(range(33)), 2), (1, list(range(33, 66)), 2), (2, list(range(66, 100)), 2)]


def test_stream_near_dedup_is_the_batch_rule(spark):
    queries = catalogue.queries()
    got, want = (sorted(r.doc_id for r in queries[n](spark, "/root/testdata/sf0.001").collect()) for n in ("stream_near_dedup", "near_dup_online_keep"))
    assert got == want


def test_folded_state(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([9, 1, 1, 1, 1, 2, 8])], "user_id long, event_id long, value double")
    assert tuple(streams.folded_state(df, limit=5).first()) == (1, 9.0, 2, 1, 0, 1)


def events(spark, n, keys=3):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    return spark.range(n).select((F.col("id") % keys).alias("user_id"), F.col("id").alias("event_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("event_type"), at.alias("ts"), (F.col("id") * 7 % 10).cast("double").alias("value"))


def test_keyed_state_over_batches_is_one_fold(spark, tmp_path):
    """Two batches, and two batches that begin with the state after earlier events, end where one fold over all events ends."""
    df = events(spark, 200)
    fold = {r.user_id: tuple(r) for r in streams.folded_state(df).collect()}
    for part in ("event_id < 90", "event_id >= 90"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    run = lambda source, out, **how: streams.run_to_end(streams.keyed_state(streams.file_stream(spark, str(tmp_path / source), df.schema), **how), str(tmp_path / out), "update").collect()
    got = run("e", "o")
    end = {r.user_id: r for r in sorted(got, key=lambda r: r.seen)}
    assert len(got) == 6 and {k: tuple(r)[:6] for k, r in end.items()} == fold
    assert end[0].last == [float(i * 7 % 10) for i in range(186, 200, 3)] and end[0].kinds == "a=17,b=50" and not end[0].expired
    first = spark.createDataFrame([r for r in got if r.seen == 30], streams.FULL_STATE)
    df.filter("event_id >= 90").coalesce(1).write.parquet(str(tmp_path / "late"))
    again = {r.user_id: r for r in run("late", "o2", initial=first)}
    assert again == end


class Calls:
    """A state variable that counts what it is asked."""

    def __init__(self):
        self.n = 0

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            return {"get": None if self.kind == "value" else [], "exists": False, "containsKey": False, "iterator": []}.get(name)

        return call


def test_a_key_asks_for_its_state_once():
    """Three reads and two writes a key and batch, and a write for each kind."""
    state = streams.LastState()
    made = {}

    class Handle:
        def __getattr__(self, name):
            return lambda *args: made.setdefault(name, type("One", (Calls,), {"kind": name[3:-5].lower()})())

    state.init(Handle())
    rows = pd.DataFrame({"event_id": [2, 1], "event_type": ["a", "b"], "ts": pd.Timestamp(0), "value": [1.0, 9.0]})
    got = next(state.handleInputRows((7,), iter([rows]), None)).iloc[0]
    assert (got["best"], got["seen"], got["last"], got["kinds"]) == (9.0, 2, [9.0, 1.0], "a=1,b=1")
    assert sum(c.n for c in made.values()) == 3 + 2 + 2


def test_idle_keys_are_forgotten(spark, tmp_path):
    """A key that is quiet while event time goes on is emitted as expired and begins anew."""
    for ids in ((0, 1, 3), (900, 901), (1800, 1801), (3102,)):
        part = spark.createDataFrame([(i,) for i in ids], "id long").select(F.when(F.col("id") % 3 == 1, 1).otherwise(0).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.lit("a").alias("event_type"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.lit(1.0).alias("value"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    schema = part.schema
    stream = streams.file_stream(spark, str(tmp_path / "e"), schema)
    got = streams.run_to_end(streams.keyed_state(stream, idle="20 hours"), str(tmp_path / "o"), "update").collect()
    assert [r.seen for r in got if r.user_id == 0 and not r.expired] and max(r.seen for r in got if r.user_id == 0) == 5
    assert [r.seen for r in got if r.user_id == 1 and r.expired] != []


def test_threshold():
    assert [streams.next_threshold(60, True), streams.next_threshold(150, True), streams.next_threshold(100, False)] == [120, 200, 150]
