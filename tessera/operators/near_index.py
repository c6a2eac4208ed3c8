"""Near dedup against what was kept, by a stored index that grows with each batch.

The index has, for each kept row, the prefix of its token set (near_links.py): numbers of its first
tokens in an order that the first batch with any token fixes for all batches. A batch meets the stored
prefixes and its own, candidates are checked by the tokens themselves, of the batch and of the kept table, what is
like a kept row is dropped, and the rest is decided in order of position. Sets are stored nowhere and
move once for each cell of pairs that needs them. The batch adds its kept rows to the index under its number.

Cases: rows without tokens have no near copy and are kept. Equal sets are near. Positions are
distinct over all batches. An empty batch adds nothing. A repeated batch reads only earlier batches,
so it keeps the same rows and writes the same folders. A batch is read several times, so it should be
cheap to read, as files are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import stored
from ..functions.text import token_set
from . import near_links
from .dedup import online_keep


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class NearIndex:
    def __init__(self, folder: str, text: str = "text", position: str = "doc_id", threshold: float = 0.8):
        self.folder, self.text, self.position, self.threshold = folder, text, position, threshold

    def _earlier(self, spark: SparkSession, kind: str, number: int) -> DataFrame | None:
        path = f"{self.folder}/{kind}"
        return spark.read.parquet(path).filter(F.col("batch") < number) if number and _exists(spark, path) else None

    def _docs(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.position).cast("long").alias("id"), F.col(self.text).alias("text"))

    def _order(self, docs: DataFrame, number: int) -> np.ndarray:
        """The tokens' order, by the counts of the first batch that had any, stored with it. A row of bucket -1 says that it had, even if none came twice."""
        spark, path = docs.sparkSession, f"{self.folder}/order"
        stored = self._earlier(spark, "order", number)
        first = stored.agg(F.min("batch")).first()[0] if stored is not None else None
        if first is None:
            any_ = docs.filter(F.size(token_set(F.col("text"))) > 0).limit(1).select(F.lit(-1).alias("bucket"), F.lit(0).alias("level"))
            near_links.token_counts(docs).union(any_).write.mode("overwrite").parquet(f"{path}/batch={number}")
            counts = spark.read.schema("bucket int, level int").parquet(f"{path}/batch={number}")
        else:
            counts = stored.filter(F.col("batch") == first)
        return near_links.token_order(counts.filter("bucket >= 0"))

    def add(self, batch: DataFrame, number: int) -> None:
        """Keep the batch's rows that are new, and index them."""
        spark, t, docs = batch.sparkSession, self.threshold, self._docs(batch)
        links_of = lambda left, right, of: near_links.verified(stored(near_links.candidates(left, right, t)), of, t, "text", "id").select("a", "b")
        # Equal sets of a batch: the first stands for all. Tokens that come once here may come again later, so they stay in the prefixes.
        fresh = stored(near_links.prefixes(docs, self._order(docs, number), t, "text", "id", alone=True))
        items = self._earlier(spark, "items", number)
        if items is not None:
            known = docs.union(self._docs(self._earlier(spark, "kept", number)))
            near = links_of(items.drop("batch"), fresh, known).select(F.col("b").alias("id")).distinct()
            fresh = stored(fresh.join(near_links.few(stored(near)), "id", "left_anti"))
        links = stored(links_of(fresh, None, docs))
        linked = stored(links.select(F.col("a").alias("id")).union(links.select("b")).distinct())
        # What goes is little beside what stays.
        gone = near_links.few(stored(online_keep(linked, links, stored).filter("not kept").select("id")))
        fresh = fresh.join(gone, "id", "left_anti")
        kept = stored(fresh.select("id"))
        out = lambda df, kind: df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={number}")
        out(fresh, "items")
        wordless = docs.filter(F.col("text").isNull() | ~F.col("text").rlike(r"(?U)\S")).select("id")
        stays = kept.union(wordless).withColumnRenamed("id", "__id")
        # Ids go to the texts, not texts through a shuffle, but for very large batches.
        few = kept.count() <= near_links.BROADCAST_ROWS
        out(batch.join(F.broadcast(stays) if few else stays, F.col(self.position).cast("long") == F.col("__id"), "left_semi"), "kept")
