"""Mixing sources to target weights.

Tokens are aggregated per source, each source's target gives its repetition rate, and a document
is emitted floor(rate) times plus once more with probability equal to the fraction, decided by a
hash of the seed and its id. The whole-table work is one narrow aggregation and one join with the
table of sources. Up to MOST_SOURCES sources the table of rates is counted and then broadcast, so
rows and texts aren't shuffled; beyond that, rows are joined by (source, salt), so that a source
that a third of all rows have is split over SALTS tasks.

A source's taken words differ from its target by chance: the fractional copies are independent
draws, so the standard deviation is at most half the root of the sum of its squared sizes (sf0.1:
the worst of the sources is given in tests/llm, 16 % at 50 documents a source).

A null text has size 0, a null source is a source of its own (last in order), and a source whose
size is 0 has target 0 and takes nothing. Repeated rows of one id share one draw, so they are taken
alike. Ties can't arise: sources are distinct. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"
#: Sources whose rates are broadcast (some 50 bytes each), and the parts of a source where there are more.
MOST_SOURCES, SALTS = 50_000, 64


def words(text_col: str = "text"):
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    # A word starts where a character that is no space follows a space or the start.
    spaced = F.translate(F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))), SPACES[1:], " " * 5)
    return F.coalesce(F.regexp_count(spaced, F.lit(" [^ ]")), F.lit(0)).cast("long")


def draw(id_col: str = "doc_id", seed: str = SEED):
    """A number in [0, 1) from 48 bits of md5(seed|id); any engine can compute it."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> also target and rate = target / source_size.

    Sources in code point order, null last, weigh weights in turn. They share `share` of all
    sizes; none gets over `limit` times its own size, and the excess is shared out again by
    weight until none is above. Each round is one aggregation over the table of sources, so the
    number of sources has no bound; a round only ever adds capped sources, so it ends.
    """
    # A range sort, and places within it from the partitions' sizes: no window over all sources in one task.
    held = checkpointed(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offset = 0, [F.lit(0), F.lit(0)]
    for p, n in sorted(held.groupBy(part.alias("part")).count().collect()):
        offset += [F.lit(p), F.lit(before)]
        before += n
    place = row + F.coalesce(F.try_element_at(F.create_map(*offset[2:] or offset), part), F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    w = checkpointed(held.select("source", "source_size", weight.alias("weight")))
    total = (w.agg(F.sum("source_size")).first()[0] or 0) * share
    level = -1.0
    cap = F.col("source_size") * limit
    while True:
        capped = cap <= F.col("weight") * F.lit(level)
        used, free = w.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        new = (total - used) / free
        if new <= level:
            break
        level = new
    target = F.least(cap, F.col("weight") * F.lit(level)) if level >= 0 else F.lit(0.0)
    return w.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _with_rates(rows: DataFrame, sized: DataFrame, most: int | None = None, **how) -> DataFrame:
    """rows (doc_id, source, ...) with source_size, target and rate of their source, by the sizes in sized."""
    targets = checkpointed(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how))
    targets = targets.select(F.col("source").alias("of_source"), "source_size", "target", "rate")
    same = F.col("source").eqNullSafe(F.col("of_source"))
    if targets.count() <= (MOST_SOURCES if most is None else most):
        return rows.join(F.broadcast(targets), same)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).cast("int"))
    parts = targets.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(parts, same & (F.col("salt") == F.col("of_salt")))


def copies(seed: str = SEED):
    """floor(rate) and one more where the draw is under the fraction."""
    return (F.floor("rate") + F.when(draw("doc_id", seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"))
    sized = checkpointed(sized)
    n = copies(seed)
    return _with_rates(sized, sized, **how).select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    rows = docs.select(held, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    sized = docs.select(F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"))
    taken = _with_rates(rows, sized, **how).select("held", copies(seed).alias("n")).filter("n > 0")
    return taken.select(F.col("held"), F.explode(F.sequence(F.lit(1), F.col("n")))).select("held.*")
