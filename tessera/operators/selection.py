"""Exact ranks and quantiles of groups without a window over a group's rows.

A key is a text of fixed length whose order is the order wanted: a digest in hex, or order_key() of a
number. Keys are counted by (group, first digits); the running sum over these few cells tells the cell
that holds a rank, and the rank within it. Only rows of such cells are counted again by more digits,
until a cell has few enough rows to be counted by whole keys. Each pass is a partial aggregation of
narrow rows; a group of any size costs the passes, and no task gets more of it than CELL_ROWS cells.

Cases: equal keys are counted together, so very many rows of one key are one cell. A rank beyond the
group's size gives no row. Null is a group of its own; null keys take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

#: Digits that a pass adds (16 to their power cells), and rows of a cell that is counted by whole keys at once.
DIGITS, CELL_ROWS = 3, 10_000


def order_key(value: Column) -> Column:
    """16 hex digits in the order of a long's values."""
    return F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def from_order_key(key: Column) -> Column:
    """The long that order_key() wrote. The first digit has the sign turned."""
    first = F.conv(F.substring(key, 1, 1), 16, 10).cast("int").bitwiseXOR(F.lit(8))
    rest = F.conv(F.substring(key, 2, 15), 16, 10).cast("long")
    return F.when(first >= 8, (first - 16).cast("long") * (1 << 60) + rest).otherwise(first.cast("long") * (1 << 60) + rest)


def group_key(groups: list[Column]) -> Column:
    """One text of all groups' columns; null isn't the empty text."""
    return F.to_json(F.struct(*[g.alias(f"g{i}") for i, g in enumerate(groups)])) if groups else F.lit("{}")


def at_ranks(df: DataFrame, groups: list[Column], key: Column, length: int, ranks: Callable[[Column], Column], cell_rows: int = CELL_ROWS) -> DataFrame:
    """group (group_key), n, rank and key of the row of each rank (from 1) in the order of keys of `length` digits. ranks: from the column of a group's size to an array of long; the column group is at hand too."""
    keyed = df.select(group_key(groups).alias("group"), key.alias("key")).filter(F.col("key").isNotNull())
    cells = keyed.groupBy("group", F.substring("key", 1, DIGITS).alias("cell")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("group")
    cells = cells.select("group", "cell", "m", F.sum("m").over(w).alias("n"), (F.sum("m").over(w.orderBy("cell")) - F.col("m")).alias("before"))
    held = cells.select("group", "cell", "m", "n", "before", F.explode(F.array_distinct(ranks(F.col("n")))).alias("rank"))
    held = checkpointed(held.filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("m"))).select("group", "n", "rank", "cell", "m", (F.col("rank") - F.col("before")).alias("rest")))
    digits = min(DIGITS, length)
    while digits < length:
        most = held.agg(F.max("m")).first()[0] or 0
        further = length if most <= cell_rows else min(length, digits + DIGITS)
        wanted = held.select("group", "cell").distinct()
        inner = keyed.withColumn("cell", F.substring("key", 1, digits)).join(wanted, ["group", "cell"], "left_semi")
        inner = inner.groupBy("group", "cell", F.substring("key", 1, further).alias("next")).agg(F.count("*").alias("k"))
        before = F.sum("k").over(Window.partitionBy("group", "cell").orderBy("next")) - F.col("k")
        inner = inner.withColumn("before", before).join(held, ["group", "cell"]).filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("k")))
        held = checkpointed(inner.select("group", "n", "rank", F.col("next").alias("cell"), F.col("k").alias("m"), (F.col("rest") - F.col("before")).alias("rest")))
        digits = further
    return held.select("group", "n", "rank", F.col("cell").alias("key"))


def first_of_groups(df: DataFrame, groups: list[Column], key: Column, length: int, wanted: Callable[[Column], Column], flag: str) -> DataFrame:
    """df with the boolean column flag: whether the row is among the first wanted(n) of its group of n rows. Rows of equal keys are in or out together."""
    cuts = at_ranks(df, groups, key, length, lambda n: F.array(F.least(wanted(n).cast("long"), n.cast("long"))))
    named = df.withColumns({"__group": group_key(groups), "__key": key})
    cuts = cuts.select(F.col("group").alias("__group"), F.col("key").alias("__cut"))
    return named.join(cuts, "__group", "left").withColumn(flag, F.coalesce(F.col("__key") <= F.col("__cut"), F.lit(False))).drop("__group", "__key", "__cut")
