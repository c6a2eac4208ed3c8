"""Queries that run events as a stream of files up to what is there now."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import scratch_path
from ..streaming import streams
from .registry import Registry, table

registry = Registry()


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files as a stream: its folder filtered by name, or the folder that it is."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if fs.getFileStatus(hadoop).isDirectory() else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _end(stream: DataFrame, mode: str = "append") -> DataFrame:
    return streams.run_to_end(stream, scratch_path(stream.sparkSession, "stream"), mode)


def _in_parts(df: DataFrame, cuts: list, column: str) -> Iterator[DataFrame]:
    """A table as a stream, a batch for the rows up to each cut of a column, in turn, and for the rest. The same folder's stream is given once its next files are there, for a run that goes on from the last one's checkpoint.

    All tasks write a part, and only one part is there at a time.
    """
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "parts")
    low = None
    for high in [*cuts, None]:
        part = df if low is None else df.filter(F.col(column) > low)
        (part if high is None else part.filter(F.col(column) <= high)).write.mode("overwrite").parquet(folder)
        yield streams.file_stream(spark, folder, df.schema, None)
        low = high


@registry.add("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, user_id FROM events) GROUP BY ALL")
def stream_append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each by id, with a watermark that bounds the state, counted afterwards."""
    return _end(streams.unique_events(_source(spark, sf_dir), ["event_id"])).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


STATE_SQL = """
WITH e AS (SELECT *, value < 3.0 AS low, sum(CASE WHEN value < 3.0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
runs AS (SELECT user_id, island, count(*) FILTER (WHERE low) AS n FROM e GROUP BY ALL),
alarms AS (SELECT user_id, sum(n // 4)::BIGINT AS alarms, (arg_max(n, island) % 4)::BIGINT AS run FROM runs GROUP BY user_id),
kinds AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id),
last AS (SELECT user_id, string_agg(round(value * 100)::BIGINT::VARCHAR, ',' ORDER BY event_id) AS last_cents FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5) GROUP BY user_id)
SELECT user_id, max(value) AS best, count(*) % 50 AS rows, count(*) // 50 AS resets, any_value(run) AS run, any_value(alarms) AS alarms, count(*) AS seen, any_value(last_cents) AS last_cents, any_value(kinds) AS kinds
FROM events JOIN alarms USING (user_id) JOIN kinds USING (user_id) JOIN last USING (user_id) GROUP BY user_id
"""


@registry.add(STATE_SQL)
def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches through the state store: best value, counter with resets, run of low values with alarms, last five values and counts by kind of each key, after all of them."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.max("event_id")).first()[0] or 0
    out = scratch_path(spark, "stream")
    for part in _in_parts(events, [n // 3, 2 * n // 3], "event_id"):
        states = streams.run_to_end(streams.keyed_state(part), out, "update")
    last = states.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in states.columns if c != "user_id"]), "seen").alias("s")).select("user_id", "s.*")
    cents = F.array_join(F.transform("last", lambda v: F.round(v * 100).cast("long").cast("string")), ",")
    return last.select("user_id", "best", "rows", "resets", "run", "alarms", "seen", cents.alias("last_cents"), "kinds")


@registry.add()
def stream_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three batches of a stream, each deduplicated against the stored index of what was kept: the rows of near_dup_online_keep."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.agg(F.max("doc_id")).first()[0] or 0
    folder = scratch_path(spark, "near-index")
    for part in _in_parts(docs, [n // 3, 2 * n // 3], "doc_id"):
        part.writeStream.foreachBatch(streams.dedup_against(folder)).option("checkpointLocation", f"{folder}.log").trigger(availableNow=True).start().awaitTermination()
    return streams.kept_rows(spark, folder).select("doc_id")


@registry.add()
def folded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful processor's fold, with its streaks, over a batch."""
    return streams.folded_state(table(spark, sf_dir, "events"))


@registry.add("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: event-time windows, in complete mode so that the last ones are there."""
    s = _source(spark, sf_dir)
    w = s.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return _end(w, "complete").select(F.col("w.start").alias("start"), "event_type", "n", "mean")


@registry.add("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, round((floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(last))) / 60.0, 2) AS minutes, (floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(last))) / 60.0 > 30 AS stale FROM l")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.heartbeat_age(table(spark, sf_dir, "events"))


@registry.add("SELECT event_type, min(ts) AS first, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)")
def limited_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert a category and hour: the first."""
    return streams.limited_alerts(table(spark, sf_dir, "events")).select("event_type", "first", "n")


@registry.add("SELECT user_id, event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)::BIGINT AS cents FROM events")
def rolling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, in hundredths, over the last fifty rows of each key: windows by count, not by time."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-49, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("cents"))
