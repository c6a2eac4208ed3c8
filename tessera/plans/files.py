"""Queries through files: tables written as JSON lines or CSV and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch_path
from ..operators import verify
from ..sources import files, sinks
from .registry import Registry, table

registry = Registry()


@registry.add("SELECT item_id, text, length(text) AS n FROM benchmark")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    sinks.json_overwrite(table(spark, sf_dir, "benchmark"), path)
    return files.json_lines(spark, path, "item_id long, text string").select("item_id", "text", F.length("text").alias("n"))


@registry.add("SELECT count(*) AS good, 3 AS bad, count(item_id) AS filled FROM benchmark")
def json_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and malformed lines of a tolerant scan."""
    path = scratch_path(spark, "malformed")
    good = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct("item_id", "text")).alias("value"))
    good.union(spark.createDataFrame([("{",), ("no json",), ('{"item_id": ',)], "value string")).write.text(path)
    return files.malformed(files.json_lines(spark, path, "item_id long, text string", bad="keep"))


@registry.add("SELECT conv_id::INT AS conv_id, turn::INT AS turn, role, text FROM conversations WHERE conv_id % 7 <> 0")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with quotes and line ends in fields; rows with a bad integer are left out."""
    path = scratch_path(spark, "csv")
    c = table(spark, sf_dir, "conversations").withColumn("conv_id", F.when(F.col("conv_id") % 7 == 0, "bad").otherwise(F.col("conv_id").cast("string")))
    sinks.csv(c, path, ["conv_id", "turn", "role", "text"])
    return files.typed(files.csv_strings(spark, path, ["conv_id", "turn", "role", "text"]), ["conv_id", "turn"]).select("conv_id", "turn", "role", "text")


@registry.add("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' ELSE 'rejected' END AS route FROM labels")
def routed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "routed")
    sinks.routed(verify.routed(table(spark, sf_dir, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0)), path)
    return spark.read.parquet(path).select("doc_id", "route")


@registry.add("SELECT r_name AS domain, n_name AS topic FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of structs of arrays, written as a document and taken apart again."""
    path = scratch_path(spark, "topics")
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = j.groupBy(F.col("r_name").alias("domain")).agg(F.collect_list("n_name").alias("topics"))
    groups.agg(F.collect_list(F.struct("domain", "topics")).alias("batches")).coalesce(1).write.json(path)
    return files.topics(files.json_document(spark, path, "batches array<struct<domain string, topics array<string>>>"))


DRAW = "('0x' || substr(md5('42|{k}|' || id), 1, 8))::BIGINT % 100"


@registry.add(f"""WITH d AS (SELECT id, {DRAW.format(k=1)} AS a, {DRAW.format(k=2)} AS b FROM (SELECT unnest(range((SELECT count(*) FROM part))) AS id))
SELECT id, a, b, 'What is ' || a || ' + ' || b || '?' AS question, a + b AS answer FROM d""")
def synthetic_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many seeded sums as there are parts."""
    return files.synthetic(spark, table(spark, sf_dir, "part").count())


@registry.add("SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS parsed, count(*) FILTER (WHERE value > 5) AS checked, round(avg(value), 6) AS mean, true AS newest FROM events WHERE event_id % 3 = 1")
def newest_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the newest of three result files that has rows: the last one written has only its header."""
    path = scratch_path(spark, "results")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for name, keep in (("old", "event_id % 3 = 0"), ("new", "event_id % 3 = 1"), ("empty", "false")):
        e.filter(keep).coalesce(1).write.option("header", True).csv(f"{path}/{name}")
    rows = files.newest_file(spark, path, "event_id long, event_type string, value double", header=True)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("parsed"), F.count_if(F.col("value") > 5).alias("checked"), F.round(F.avg("value"), 6).alias("mean"), F.max(F.contains("source", F.lit("/new/"))).alias("newest"))


COUNTERS = {
    "entries": "true", "empty": "text = ''", "lines": None, "chars": None, "english": "lang = 'en'", "long": "n_chars > 2000", "short": "n_chars < 50", "questions": "contains(text, '?')",
    "numbers": "regexp_matches(text, '[0-9]')", "capitals": "regexp_matches(text, '^[A-Z]')", "licensed": "contains(text, 'License')", "even": "doc_id % 2 = 0",
}
SUMS = {"lines": "len(string_split(text, chr(10)))", "chars": "n_chars"}


@registry.add(" UNION ALL ".join(f"SELECT '{name}' AS counter, coalesce(sum({SUMS.get(name) or f'({test})::INT'}), 0)::BIGINT AS n FROM documents" for name, test in COUNTERS.items()))
def harvest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve counters that come with the pass that writes the documents: the table is scanned once."""
    spark_test = lambda t: F.expr(t.replace("regexp_matches", "regexp_like"))
    exprs = {name: F.count_if(spark_test(test)) for name, test in COUNTERS.items() if test}
    exprs |= {"lines": F.sum(F.size(F.split("text", "\n"))), "chars": F.sum("n_chars")}
    path = scratch_path(spark, "harvest")
    sinks.write_counted(table(spark, sf_dir, "documents"), f"{path}/rows", f"{path}/counters", step=1, **exprs)
    return spark.read.json(f"{path}/counters").select("counter", "n")
