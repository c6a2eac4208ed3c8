"""Splits, samples and oversampling decided by a hash of a seed and the id, so that every engine and every run agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .selection import first_of_groups, group_key

#: Digits of hash_order().
HASH_DIGITS = 32


def hash_order(id_: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string")).cast("binary"))


def stratified_split(df: DataFrame, strata: list[Column], id_: str, share: float = 0.1, seed: str = "42", least: int = 1) -> DataFrame:
    """Column split: eval for max(least, int(share * n)) rows of each stratum in hash order, else train. Rows of one id stay together."""
    held = first_of_groups(df, strata, hash_order(F.col(id_), seed), HASH_DIGITS, lambda n: F.greatest(F.lit(least), F.floor(n * share)), "__eval")
    return held.withColumn("split", F.when(F.col("__eval"), "eval").otherwise("train")).drop("__eval")


def group_split(df: DataFrame, group: str, id_: str, share: float = 0.1, seed: str = "42", smallest: int = 4) -> DataFrame:
    """As above by rounded shares; groups under `smallest` rows are all train."""
    held = first_of_groups(df, [F.col(group)], hash_order(F.col(id_), seed), HASH_DIGITS, lambda n: F.when(n >= smallest, F.greatest(F.lit(1), F.bround(n * share))).otherwise(0), "__eval")
    return held.withColumn("split", F.when(F.col("__eval"), "eval").otherwise("train")).drop("__eval")


def sample(df: DataFrame, id_: str, k: int, seed: str = "42") -> DataFrame:
    """k rows: the first in hash order (a top-k, nothing is sorted whole)."""
    return df.orderBy(hash_order(F.col(id_), seed), id_).limit(k)


def bank_sample(df: DataFrame, bank: Column, id_: str, shares: dict[str, float], total: int, seed: str = "42") -> DataFrame:
    """A share of the total from each named bank in hash order, the rest from the others."""
    named = df.withColumn("bank", F.when(bank.isin(*shares), bank).otherwise("rest"))
    quota = shares | {"rest": 1 - sum(shares.values())}
    limit = F.create_map(*[x for k, v in quota.items() for x in (group_key([F.lit(k)]), F.lit(int(round(total * v))))])
    kept = first_of_groups(named, [F.col("bank")], hash_order(F.col(id_), seed), HASH_DIGITS, lambda n: F.element_at(limit, F.col("group")), "__in")
    return kept.filter("__in").drop("__in")


def ratio_capped(main: DataFrame, extra: DataFrame, id_: str, share: float = 0.3, least: int = 20, seed: str = "42") -> DataFrame:
    """main and a hash sample of extra, at most max(least, int(n * share / (1 - share))) rows."""
    return main.unionByName(sample(extra, id_, max(int(main.count() * share / (1 - share)), least), seed))


def oversample(df: DataFrame, times: Column, copy: str = "copy") -> DataFrame:
    """Each row as often as `times` says, numbered from 1; none for 0."""
    return df.withColumn("__n", times.cast("int")).filter("__n > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def shuffled(df: DataFrame, id_: Column, seed: str = "42") -> DataFrame:
    return df.orderBy(hash_order(id_, seed))


def choose(items: Column, id_: Column, k: int, seed: str = "42") -> Column:
    """k of an array's items in hash order, by row."""
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string"), F.lit("|"), x).cast("binary")).alias("h"), x.alias("x"))))
    return F.transform(F.slice(keyed, 1, k), lambda s: s["x"])


def capped_per_source(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(source).orderBy(order))).filter(F.col("__rank") <= n).drop("__rank")


def batches(df: DataFrame, order: str, size: int, group: str | None = None) -> DataFrame:
    """batch_id of rows numbered in order: within a group by a window, else over all rows by a range sort, so no task gets all rows; one row a partition is broadcast."""
    if group:
        n = F.row_number().over(Window.partitionBy(group).orderBy(order))
        return df.withColumn("batch_id", F.floor((n - 1) / size))
    # Both branches read one checkpointed copy: two range exchanges would each sample cut points of their own.
    ranged = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id()))
    part, row = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("batch_id", F.floor((F.col("__before") + row) / size)).drop("__part", "__row", "__before")
