"""Exact selection, splits and numbering against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling, selection


def test_order_keys_go_there_and_back(spark):
    values = [0, 1, -1, 5, -5, 2**62, -(2**62), 2**63 - 1, -(2**63), 10**12]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", selection.order_key(F.col("v")).alias("k")).withColumn("back", selection.from_order_key(F.col("k"))).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == sorted(values) and all(r.back == r.v and len(r.k) == 16 for r in got)


@pytest.mark.parametrize("cell_rows", [1, 50, 10_000])
def test_at_ranks(spark, cell_rows):
    """Ranks within groups with ties, a constant group, a null group and null values, refined digit by digit or at once."""
    rnd = random.Random(3)
    rows = [(g, v) for g, vs in {"a": [rnd.randint(-(10**6), 10**6) for _ in range(700)], "b": [7] * 900, None: [1, 2, 2, 3], "": [5], "c": [None]}.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    got = selection.at_ranks(df, [F.col("g")], selection.order_key(F.col("v")), 16, lambda n: F.array(F.lit(1).cast("long"), F.floor(n / 2) + 1, n, n + 1), cell_rows)
    found = {(r.group, r["rank"]): (r.n, r.v) for r in got.withColumn("v", selection.from_order_key(F.col("key"))).collect()}
    want = {}
    for g in ("a", "b", None, ""):
        vs = sorted(v for k, v in rows if k == g)
        name = "{}" if g is None else f'{{"g0":"{g}"}}'
        want |= {(name, r): (len(vs), vs[r - 1]) for r in {1, len(vs) // 2 + 1, len(vs)}}
    assert found == want


def hashed(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_splits_equal_the_rule(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["x", "y", None]), "q" if i % 50 else "rare") for i in range(800)]
    df = spark.createDataFrame(rows, "id long, g string, h string")
    groups = {}
    for i, g, h in rows:
        groups.setdefault((g, h), []).append(i)
    evals = {i for ids in groups.values() for i in sorted(ids, key=lambda i: hashed("42", i))[: max(1, int(0.1 * len(ids)))]}
    got = sampling.stratified_split(df, [F.col("g"), F.col("h")], "id")
    assert got.columns == ["id", "g", "h", "split"]
    assert {r.id for r in got.collect() if r.split == "eval"} == evals
    small = df.filter("id < 3")
    assert {r.split for r in sampling.group_split(small, "h", "id").collect()} == {"train"}
    bank = sampling.bank_sample(df, F.col("g"), "id", {"x": 0.5, "z": 0.2}, 40).collect()
    xs = sorted((i for i, g, _ in rows if g == "x"), key=lambda i: hashed("42", i))[:20]
    rest = sorted((i for i, g, _ in rows if g != "x"), key=lambda i: hashed("42", i))[:12]
    assert {r.id for r in bank} == {*xs, *rest} and len(bank) == 32
    assert sampling.stratified_split(df.limit(0), [F.col("g")], "id").count() == 0


def test_batches_number_a_wide_frame(spark):
    """More rows than the range sample, and text beside the key."""
    n = 60_000
    df = spark.range(n, numPartitions=6).select(((F.col("id") * 7919) % n).alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("text"))
    got = sampling.batches(df, "k", 15)
    assert got.count() == n and got.filter(F.col("batch_id") != F.floor(F.col("k") / 15)).count() == 0


def test_no_window_over_a_whole_group(spark):
    """Windows go over groups' cells, never over the rows."""
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    plan = sampling.stratified_split(df, [F.col("g")], "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
