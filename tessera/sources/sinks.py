"""Sinks: overwrite, append, routed, batched and atomic writes through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def json_overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Written unless it is there."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def routed(df: DataFrame, path: str, column: str = "route") -> None:
    """One pass, a folder for each route."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """The listed columns in order; others are left out, missing ones empty."""
    out = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*out).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def batch_files(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    df.write.mode("overwrite").partitionBy(batch).json(path)


def replace(df: DataFrame, path: str) -> None:
    """Written beside the old folder and put in its place by renames; the old one is kept as path.backup."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.backup"
    df.write.mode("overwrite").parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    if not fs.rename(hadoop(new), hadoop(path)):
        raise OSError(f"{new} can't be renamed to {path}")


def write_counted(df: DataFrame, path: str, log: str, step: int, **counters: Column) -> dict[str, int]:
    """df written to path as Parquet, and aggregates of its rows appended to the log by step: (step, counter, n). They are observed while the rows are written, so nothing is read twice."""
    seen = Observation()
    df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counters.items()]).write.mode("overwrite").parquet(path)
    # One row a counter.
    found = {k: seen.get[k] for k in counters}
    df.sparkSession.createDataFrame([(step, k, n) for k, n in found.items()], "step long, counter string, n long").coalesce(1).write.mode("append").json(log)
    return found


def summary(df: DataFrame, path: str, **facts: object) -> None:
    """One JSON row beside a dataset: its rows and what else is known."""
    df.agg(F.count("*").alias("rows")).select("rows", *[F.lit(v).alias(k) for k, v in facts.items()]).coalesce(1).write.mode("overwrite").json(path)


def text_table(rows: list[list], headers: list[str]) -> str:
    """A fixed-width report of a small result."""
    cells = [[str(c) for c in r] for r in [headers, *rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(cells[0]), "  ".join("-" * w for w in widths), *map(line, cells[1:])])


def bundle(**parts: DataFrame) -> DataFrame:
    """One row with one JSON text of several small results, a list each."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.collect_list(F.struct("*")).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*parts)).alias("json"))
