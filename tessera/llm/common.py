"""Helpers that several operators share: table reads, checkpoints, text slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D]; bytes.split() splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()

#: Bytes of text that a Python task turns into words at a time.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it is unset a temporary one is set on one machine; on a cluster that is an error, as others couldn't read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder: computed once, and kept when executors are lost."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for tables that are written and read again."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key with more rows than this (or than an even share of HOT_KEYS keys) is hot, so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 1 << 16


def hot_keys(left: DataFrame, key: str) -> DataFrame | None:
    """The hot keys of left, one row each and HOT_KEYS at most; None if there are none. Counted by partial aggregation."""
    counts = checkpointed(left.groupBy(key).agg(F.count("*").alias("hot_n")))
    total = counts.agg(F.sum("hot_n")).first()[0] or 0
    hot = counts.filter(F.col("hot_n") > max(HOT_ROWS, total // HOT_KEYS)).select(key)
    return hot if hot.head(1) else None


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left join right (one row a key). Rows of hot keys stay where they are and meet the broadcast rows of right, as those are HOT_KEYS at most; the others are joined by key. left is read twice."""
    hot = hot_keys(left, key)
    if hot is None:
        return left.join(right, key, how)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(right, key, how))


def id_crc(id_col: str = "doc_id"):
    """crc32 of the id written as text, as a long."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit; a longer row has a range of its own."""
    start = total = end = 0
    for end, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x, ascending, by a sort."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


_POWER = {"n": 0}


def run_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run raw[begin:end] of bytes, whatever its place."""
    if _POWER["n"] < len(raw) + 1:
        n = 2 * len(raw) + 1
        base = 0x9E3779B97F4A7C15
        _POWER.update(n=n, up=np.cumprod(np.full(n, base, np.uint64)), down=np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64)), value=np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(_POWER["value"][raw] * _POWER["up"][: len(raw)])]
    h = (total[end] - total[begin]) * _POWER["down"][begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes."""
    space = np.r_[True, _SPACE[raw], True]
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df hasn't, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (f"{base}_{i}" for i in range(len(taken) + 1)) if c not in taken)


def rows_with_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs whose id and hash of the text are a row (id, text_hash) of ids (null is an id), and one of those that have the same id and text. Texts are shuffled once: the window's keys start with the join's."""
    row, missing, known, text_hash = (fresh_name(docs, x) for x in ("row", "missing", "known", "text_hash"))
    own = F.col(id_col).cast("long")
    keyed = docs.withColumns({missing: own.isNull(), known: F.coalesce(own, F.lit(0)), text_hash: F.xxhash64(F.col(text_col).cast("string"))})
    wanted = ids.select(F.col("id").isNull().alias(missing), F.coalesce("id", F.lit(0)).cast("long").alias(known), F.col("text_hash").alias(text_hash))
    w = Window.partitionBy(missing, known, text_hash, F.col(text_col)).orderBy(F.lit(0))
    return keyed.join(wanted, [missing, known, text_hash], "left_semi").withColumn(row, F.row_number().over(w)).filter(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
