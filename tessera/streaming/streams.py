"""Structured Streaming: append logs, exact and near dedup against what was kept, keyed state, streaks, alerts, event-time windows."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files: int | None = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch; None: all that are new."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run_to_end(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, through Parquet files in path: a folder a batch, which a repeated batch writes anew, or in complete mode the last batch's alone."""
    whole = mode == "complete"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if whole else f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}.log")
    writer.start().awaitTermination()
    spark = stream.sparkSession
    if not exists(spark, path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows" if whole else path).select(*stream.columns)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log; the checkpoint makes a restart go on where it stopped."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark on a column that may be a timestamp without a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def unique_events(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """First of each key; the watermark bounds the state."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def dedup_against(folder: str, text: str = "text", position: str = "doc_id", threshold: float = 0.8):
    """foreachBatch: rows that no kept row before them is like, by content or by token set, are added to the kept table in `folder` (kept_rows()).

    A stored index (operators/near_index.py) of the kept rows is probed and extended, so a batch costs its own rows and what they meet. Each batch has folders of its own and reads only those of smaller numbers: a
    repeated batch writes the same again. Positions are distinct over all batches.
    """
    from ..operators.near_index import NearIndex

    index = NearIndex(folder, text, position, threshold)
    return index.add


def kept_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What dedup_against() has kept so far."""
    return spark.read.parquet(f"{folder}/kept").drop("batch")


class LastState(StatefulProcessor):
    """Per key the best rank so far, rows since a reset at `limit`, the run of low values, which begins anew at `streak`, the last five values, and how many rows each kind had.

    Values are taken in order of event within a batch: a task holds 16 bytes a row of one key's batch.
    Keys without a row for `idle_ms` of event time are emitted once more, as expired, and forgotten; 0 keeps them.
    """

    LAST = 5

    def __init__(self, limit: int = 50, low: float = 3.0, streak: int = 4, idle_ms: int = 0):
        self.limit, self.low, self.streak, self.idle_ms = limit, low, streak, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "best double, rows long, resets long, run long, alarms long, seen long")
        self.last = handle.getListState("last", "value double")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def _row(self, key, state: tuple, last: list, kinds: dict, expired: bool) -> pd.DataFrame:
        best, n, resets, run, alarms, seen = state
        shown = ",".join(f"{k}={v}" for k, v in sorted(kinds.items()))
        return pd.DataFrame({"user_id": [key[0]], "best": [best], "rows": [n], "resets": [resets], "run": [run], "alarms": [alarms], "seen": [seen], "last": [last], "kinds": [shown], "expired": [expired]})

    def _known(self) -> tuple[tuple | None, list, dict]:
        """The key's state, each part asked for once: every call goes to the JVM and back."""
        return self.state.get(), [x[0] for x in self.last.get()], {k[0]: v[0] for k, v in self.kinds.iterator()}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.state.update((float(row["best"]), int(row["rows"]), int(row["resets"]), int(row["run"]), int(row["alarms"]), int(row["seen"])))
        self.last.put([(float(v),) for v in row["last"]])
        for k, v in (x.rsplit("=", 1) for x in row["kinds"].split(",") if x):
            self.kinds.updateValue((k,), (int(v),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, last, kinds = self._known()
        best, n, resets, run, alarms, seen = state or (float("-inf"), 0, 0, 0, 0, 0)
        parts, newest = [], 0
        for pdf in rows:
            parts.append((pdf["event_id"].to_numpy("i8"), pdf["value"].to_numpy("f8")))
            for kind, m in Counter(pdf["event_type"].dropna().tolist()).items():
                kinds[kind] = kinds.get(kind, 0) + m
            if self.idle_ms:
                newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
        ids, values = (np.concatenate(x) for x in zip(*parts))
        for value in values[np.argsort(ids, kind="stable")].tolist():
            best, n, seen = max(best, value), n + 1, seen + 1
            if n == self.limit:
                n, resets = 0, resets + 1
            run = run + 1 if value < self.low else 0
            if run == self.streak:
                run, alarms = 0, alarms + 1
            last = [*last[1 - self.LAST :], value]
        state = (best, n, resets, run, alarms, seen)
        self.state.update(state)
        self.last.put([(v,) for v in last])
        for kind, m in kinds.items():
            self.kinds.updateValue((kind,), (m,))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.idle_ms)
        yield self._row(key, state, last, kinds, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._row(key, *self._known(), True)
        for state in (self.state, self.last, self.kinds):
            state.clear()

    def close(self) -> None:
        pass


STATE = "user_id long, best double, rows long, resets long, run long, alarms long"
FULL_STATE = STATE + ", seen long, last array<double>, kinds string, expired boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(stream: DataFrame, initial: DataFrame | None = None, idle: str | None = None, late: str = "0 seconds", **settings) -> DataFrame:
    """A row per key and batch with its state after it (FULL_STATE). initial: states to begin with, of the same columns. idle: event time, such as '2 days', after which a key is forgotten."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # The stream's own Python process doesn't get the files that are sent to executors: the processor goes as a whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    timed = _timed(stream, "ts", late) if idle else stream
    processor = LastState(**settings, idle_ms=idle_ms)
    grouped = timed.select("user_id", "event_id", "event_type", "ts", "value").groupBy("user_id")
    return grouped.transformWithStateInPandas(processor, outputStructType=FULL_STATE, outputMode="Update", timeMode="EventTime" if idle else "None", initialState=initial.groupBy("user_id") if initial is not None else None)


def folded_state(df: DataFrame, limit: int = 50, low: float = 3.0, streak: int = 4) -> DataFrame:
    """The same state over a batch, for checks and for engines without the state store: one fold a key, in order of event."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        best, n, resets, run, alarms = float("-inf"), 0, 0, 0, 0
        for value in pdf.sort_values("event_id")["value"]:
            best, n = max(best, value), n + 1
            if n == limit:
                n, resets = 0, resets + 1
            run = run + 1 if value < low else 0
            if run == streak:
                run, alarms = 0, alarms + 1
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "best": [best], "rows": [n], "resets": [resets], "run": [run], "alarms": [alarms]})

    return df.select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(fold, STATE)


def limited_alerts(stream: DataFrame, every: str = "1 hour", time: str = "ts") -> DataFrame:
    """At most one alert a category and period: the first."""
    return _timed(stream, time, every).groupBy(F.window(time, every), "event_type").agg(F.min(time).alias("first"), F.count("*").alias("n"))


def event_windows(stream: DataFrame, size: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Extension: tumbling event-time windows with a watermark; the reference of this library's operators has none."""
    return _timed(stream, time, late).groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def heartbeat_age(df: DataFrame, time: str = "ts", limit_minutes: int = 30):
    """Age of the last row of each key against the newest of all, and whether it is over the limit."""
    last = df.groupBy("user_id").agg(F.max(time).alias("last"))
    newest = df.agg(F.max(time).alias("newest"))
    age = (F.unix_timestamp("newest") - F.unix_timestamp("last")) / 60
    return last.crossJoin(F.broadcast(newest)).select("user_id", F.round(age, 2).alias("minutes"), (age > limit_minutes).alias("stale"))


def next_threshold(threshold: int, regressed: bool, most: int = 200) -> int:
    """Doubled up to a limit after a regression, else 50 more."""
    return min(threshold * 2, most) if regressed else min(threshold + 50, most)
