"""Best-per-key, quotas, pairs, streaks and running values as windows over explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import first_by


def best_per_key(df: DataFrame, key: str, better: list[Column], position: str) -> DataFrame:
    """The row that ranks first by `better` (descending), the earlier one of equals."""
    return first_by(df, [key], [*[c.desc() for c in better], F.col(position)])


def top_per_group(df: DataFrame, group: str | list, order: list, n: int, rank: str = "rank") -> DataFrame:
    keys = [group] if isinstance(group, str) else group
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def quota_then_fill(df: DataFrame, group: str, order: list, quota: int, total: int) -> DataFrame:
    """Up to `quota` rows a group, then the rest in order, `total` rows in all; phase tells which (0 or 1)."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.withColumn("phase", F.when(F.col("__rank") <= quota, 0).otherwise(1)).drop("__rank").orderBy("phase", *order).limit(total)


def best_and_worst(df: DataFrame, key: str, value: str, row: str, gap: float = 0.0) -> DataFrame:
    """key, best, worst, best_value, worst_value where they differ by the gap at least. One aggregation; ties to the smaller row id."""
    hi, lo = F.struct(F.col(value), (-F.col(row)).alias("n")), F.struct(F.col(value), F.col(row).alias("n"))
    out = df.groupBy(key).agg(F.max(hi).alias("h"), F.min(lo).alias("l"))
    out = out.select(key, (-F.col("h.n")).alias("best"), F.col("l.n").alias("worst"), F.col(f"h.{value}").alias("best_value"), F.col(f"l.{value}").alias("worst_value"))
    return out.filter((F.col("best") != F.col("worst")) & (F.col("best_value") - F.col("worst_value") >= gap))


def best_against_worst(df: DataFrame, key: str, value: str, row: str, digest: str, n: int = 3, gap: float = 0.01) -> DataFrame:
    """The best row of a key with up to n others of other content and a lower value by the gap, from the bottom."""
    best = first_by(df, [key], [F.desc(value), row]).select(F.col(key), F.col(row).alias("chosen"), F.col(value).alias("chosen_value"), F.col(digest).alias("__digest"))
    other = df.join(best, key).filter((F.col(digest) != F.col("__digest")) & (F.col("chosen_value") - F.col(value) >= gap))
    return top_per_group(other, key, [value, row], n).select(key, "chosen", "chosen_value", F.col(row).alias("rejected"), F.col(value).alias("rejected_value"), "rank")


def last_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The last n rows: a top-k, no window over all rows."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def below_for(df: DataFrame, key: list, order: str, value: str, n: int, floor: float) -> Column:
    """Whether the last n rows, this one included, are all below the floor; false before there are n."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(1 - n, 0)
    return (F.count(F.lit(1)).over(w) >= n) & (F.max(value).over(w) < floor)


def streaks(df: DataFrame, key: list, order: str, on: Column, name: str = "streak") -> DataFrame:
    """Length of the run of rows, this one included, on which the condition holds (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(order)
    island = F.sum(F.when(on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("__on", on).withColumn("__island", island)
    run = F.sum(F.col("__on").cast("int")).over(Window.partitionBy(*key, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.when(F.col("__on"), run).otherwise(0)).drop("__on", "__island")


def repeats(df: DataFrame, key: list, order: str, value: str, name: str = "repeats") -> DataFrame:
    """How many rows in a row have had this value."""
    w = Window.partitionBy(*key).orderBy(order)
    change = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    out = df.withColumn("__change", change)
    out = out.withColumn("__run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn(name, F.row_number().over(Window.partitionBy(*key, "__run").orderBy(order))).drop("__run", "__change")


def deltas(df: DataFrame, key: list, order: str, rank: str) -> DataFrame:
    """Each row with the change of its rank against the one before; first ones are left out."""
    before = F.lag(rank).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("before", before).filter("before is not null").withColumn("change", F.when(F.col(rank) > F.col("before"), "improved").when(F.col(rank) < F.col("before"), "regressed").otherwise("same"))


def running_max(value: str, key: list, order: str) -> Column:
    return F.max(value).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def since_reset(df: DataFrame, key: list, order: str, value: str, reset: Column, name: str = "accumulated") -> DataFrame:
    """Running sum that begins anew after a row on which reset holds."""
    w = Window.partitionBy(*key).orderBy(order)
    era = F.coalesce(F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("__era", era)
    return out.withColumn(name, F.sum(value).over(Window.partitionBy(*key, "__era").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("__era")


def earlier_text(df: DataFrame, key: str, order: str, text: str, name: str = "prefix", sep: str = "\n") -> DataFrame:
    """All text of the key before this row, in order; a key is one conversation or document."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.array_join(F.collect_list(text).over(w), sep))


def until_first(df: DataFrame, key: str, order: str, stop: Column, better: list[Column]) -> DataFrame:
    """The best row of each key among its rows up to the first on which stop holds."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tried = df.withColumn("__stopped", F.coalesce(F.max(stop.cast("int")).over(w), F.lit(0))).filter("__stopped = 0").drop("__stopped")
    return best_per_key(tried, key, better, order)
