"""Exact dedup by content sort.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]. Rows are sorted by
(normalised bytes, longer original first, id): splitters taken from a sample of whole keys deal the
rows to partitions by that order, Spark's external sorter sorts each partition by it, and every row
is compared in full with its neighbour. The first row of a run of equal texts is the one that stays.
As length and id are part of the key, a text that a third of all rows share is split over many
partitions like any other rows; what a split leaves open, the first and last run of each partition,
is closed by grouping those few runs by their whole text.

Splitters: a sample of at most about SAMPLE_BYTES of keys, cut at even weights of bytes, and each
shortened to the bytes that tell it from the key before it; only those are broadcast. Partitions
hold about PARTITION_BYTES; beyond SAMPLE_BYTES / (SAMPLES x mean text) partitions they grow instead.

Null text counts as empty, and a null id sorts first. Rows that repeat an id and its text are
members of one group, and one of them is kept. An empty table gives an empty result. Only the id
and the text decide, so further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, SPACES, checkpointed

#: Bytes of keys of a partition, sampled keys a partition, and bytes of keys that the driver samples.
PARTITION_BYTES, SAMPLES, SAMPLE_BYTES = 48 << 20, 24, 48 << 20
#: What a row weighs besides its text.
ROW_BYTES = 64
#: Bytes of text of an output batch of the first pass.
FLUSH_BYTES = 4 << 20

_LEAST = -(1 << 63)
_RUNS = "doc_id long, keep_id long, group_size long, text_sha256 string, first boolean, part int, edge int, edge_text binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()), ("first", pa.bool_()), ("part", pa.int32()), ("edge", pa.int32()), ("edge_text", pa.binary())])
Splitter = tuple[bytes, int, int]


def _norm(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes().translate(None, SPACE_BYTES) if text.is_valid else b""


def _order_id(doc_id: int | None) -> int:
    return _LEAST - 1 if doc_id is None else doc_id


def splitters(sample: list[tuple[bytes, int, int | None]], partitions: int) -> list[Splitter]:
    """sample: (normalised text, minus the length, id). Up to partitions - 1 keys at even weights, ascending, each as short as tells it from the sampled key before."""
    keys = sorted((norm, size, _order_id(doc_id)) for norm, size, doc_id in sample)
    if not keys or partitions < 2:
        return []
    weight = np.cumsum([len(k[0]) + ROW_BYTES for k in keys])
    out: list[Splitter] = []
    for at in sorted({int(i) for i in np.searchsorted(weight, weight[-1] * np.arange(1, partitions) / partitions)} - {0}):
        before, key = keys[at - 1], keys[at]
        if before[0] != key[0]:
            n = next((i for i, (a, b) in enumerate(zip(before[0], key[0])) if a != b), min(len(before[0]), len(key[0])))
            key = (key[0][: n + 1], _LEAST, _LEAST - 1)
        if not out or out[-1] < key:
            out.append(key)
    return out


def _sample(rows: DataFrame) -> tuple[list[tuple[bytes, int, int | None]], int]:
    """Sampled keys of rows (doc_id, text), and the number of partitions."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n, total = rows.agg(F.count("*"), F.sum(size + ROW_BYTES)).first()
    partitions = max(1, -(-(total or 0) // PARTITION_BYTES))
    want = min(SAMPLES * partitions, SAMPLE_BYTES // max(1, (total or 0) // max(1, n)))
    # A share of ids by hash; the rows of one id go together, which a second hash of the length parts.
    share = min(1.0, want / max(1, n))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.lit("splitters")), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = picked.select("doc_id", F.translate(F.coalesce("text", F.lit("")), SPACES, "").cast("binary").alias("norm"), (-F.length(F.coalesce("text", F.lit("")))).alias("size"))
    return [(bytes(r.norm), r.size, r.doc_id) for r in keys.collect()] if partitions > 1 else [], partitions


def _sorted(rows: DataFrame, keep_text: bool = False) -> tuple[DataFrame, list[Splitter]]:
    """rows: doc_id, text and further columns -> pid, norm, doc_id, (text,) further columns: dealt by splitters to partition pid, sorted by norm, longest first, id. Also the splitters."""
    sample, partitions = _sample(rows)
    found = splitters(sample, partitions)
    shared = rows.sparkSession.sparkContext.broadcast(found)
    after = 1 if keep_text else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = shared.value
        for batch in batches:
            doc_id, text = batch.column(0), batch.column(1)
            ids = doc_id.to_pylist()
            lengths = pc.fill_null(pc.utf8_length(text), 0).to_pylist()
            norms, parts, start, held = [], [], 0, 0
            for i, t in enumerate(text):
                norm = _norm(t)
                norms.append(norm)
                parts.append(bisect_right(splits, (norm, -lengths[i], _order_id(ids[i]))))
                held += len(norm)
                if held >= FLUSH_BYTES or i + 1 == len(text):
                    size = [-x for x in lengths[start : i + 1]]
                    further = [c.slice(start, len(norms)) for c in (doc_id, *batch.columns[after:])]
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(norms, pa.binary()), pa.array(size, pa.int64()), *further], ["pid", "norm", "size", "doc_id", *batch.schema.names[after:]])
                    norms, parts, start, held = [], [], i + 1, 0
        pa.default_memory_pool().release_unused()

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[after:])
    dealt = rows.mapInArrow(run, f"pid int, norm binary, size long, doc_id long{kinds}")
    return dealt.repartitionById(len(found) + 1, F.col("pid")).sortWithinPartitions("norm", "size", "doc_id").drop("size"), found


def _starts(norm: pa.Array, last: bytes | None) -> np.ndarray:
    """Whether each row of a sorted batch begins a run: a full comparison with the row before it."""
    same = np.zeros(len(norm), bool)
    if len(norm):
        same[0] = last is not None and norm[0].as_buffer().to_pybytes() == last
        same[1:] = pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
    return ~same


class _Run:
    """The open run: ids of its rows so far, and its text."""

    __slots__ = ("text", "ids", "edge")

    def __init__(self, text: bytes, edge: int | None):
        self.text, self.ids, self.edge = text, [], edge

    def emit(self, part: int) -> pa.RecordBatch:
        """All rows of the run; only an edge run passes its text on, with its first row."""
        ids = pa.concat_arrays(self.ids)
        n = len(ids)
        first = np.arange(n) == 0
        sha = hashlib.sha256(self.text).hexdigest()
        text = pa.array([self.text if self.edge is not None else None], pa.binary()).take(pa.array(np.where(first, 0, -1), mask=~first))
        return pa.RecordBatch.from_arrays([ids, pa.repeat(ids[0], n), pa.array(np.full(n, n)), pa.repeat(sha, n), pa.array(first), pa.array(np.full(n, part, np.int32)), pa.array([self.edge], pa.int32()).take(pa.array(np.zeros(n, np.int64))), text], schema=_ARROW)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """norm, doc_id in sorted order -> the rows with the run they belong to. Holds the ids and the text of one run, and a batch."""
    part, run = TaskContext.get().partitionId(), None
    for batch in batches:
        norm, doc_id = batch.column(0), batch.column(1)
        begin = np.flatnonzero(_starts(norm, run.text if run else None))
        head = int(begin[0]) if len(begin) else batch.num_rows
        if run is not None and head:
            run.ids.append(doc_id.slice(0, head))
        if not len(begin):
            continue
        if run is not None:
            yield run.emit(part)
        edge = 0 if run is None else None
        # Runs that end within the batch go out together; the first of a partition and the last of a batch alone.
        a = 0
        if edge == 0 and len(begin) > 1:
            first = _Run(norm[int(begin[0])].as_buffer().to_pybytes(), 0)
            first.ids.append(doc_id.slice(int(begin[0]), int(begin[1] - begin[0])))
            yield first.emit(part)
            a, edge = 1, None
        if len(begin) - a > 1:
            own = begin[a:-1]
            size = np.diff(begin[a:])
            sha = [hashlib.sha256(norm[int(i)].as_buffer()).hexdigest() for i in own]
            which = np.repeat(np.arange(len(own)), size)
            rows = np.arange(begin[a], begin[-1])
            none = pa.nulls(len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([doc_id.slice(int(begin[a]), len(rows)), doc_id.take(pa.array(own[which])), pa.array(size[which]), pa.array(sha).take(pa.array(which)), pa.array(rows == own[which]), pa.array(np.full(len(rows), part, np.int32)), none, pa.nulls(len(rows), pa.binary())], schema=_ARROW)
        run = _Run(norm[int(begin[-1])].as_buffer().to_pybytes(), edge)
        run.ids.append(doc_id.slice(int(begin[-1])))
    if run is not None:
        if run.edge is None:
            run.edge = 1
        yield run.emit(part)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the row of the group with the most code points in the original text, then the
    smallest id (nulls first).
    """
    in_order, _ = _sorted(_rows(docs, id_col, text_col))
    runs = checkpointed(in_order.select("norm", "doc_id").mapInArrow(_find_runs, _RUNS))
    # At most two runs a partition touch its ends; only these can go on in another partition.
    ends = runs.filter(F.col("edge_text").isNotNull()).select("part", "edge", "keep_id", "group_size", "edge_text")
    whole = ends.groupBy("edge_text").agg(F.min("part").alias("first_part"), F.min_by("keep_id", "part").alias("whole_keep"), F.sum("group_size").alias("whole_size"))
    closed = ends.join(whole, "edge_text").select("part", "edge", "first_part", "whole_keep", "whole_size")
    # Two rows of five numbers a partition, so the broadcast has a bound.
    out = runs.join(F.broadcast(closed), ["part", "edge"], "left")
    return out.select("doc_id", F.when(F.col("first_part").isNull(), F.col("keep_id")).otherwise(F.col("whole_keep")).alias("keep_id"), F.coalesce("whole_size", "group_size").alias("group_size"), (F.col("first") & (F.coalesce("first_part", "part") == F.col("part"))).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they were. Rows travel through the sort whole: it is the only shuffle.

    The first row of each run stays, unless the run began in a partition before. That is certain
    where a partition starts at a whole key (not a shortened one) with the run's text, as a whole
    key was sampled after an equal text, which lies before it; and it can't be elsewhere.
    """
    others = [c for c in docs.columns if c != text_col]
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    in_order, found = _sorted(held, keep_text=True)
    goes_on = {i + 1: s[0] for i, s in enumerate(found) if s[1] != _LEAST}
    shared = docs.sparkSession.sparkContext.broadcast(goes_on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            norm = batch.column(1)
            if last is None:
                last = shared.value.get(batch.column(0)[0].as_py())
            own = batch.take(pa.array(np.flatnonzero(_starts(norm, last))))
            last = norm[batch.num_rows - 1].as_buffer().to_pybytes()
            yield pa.RecordBatch.from_arrays(own.columns[3:], own.schema.names[3:])

    kept = in_order.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in in_order.schema.fields[3:]))
    names = {c: f"c{i}" for i, c in enumerate(others)} | {text_col: "text"}
    return kept.select(*[F.col(names[c]).alias(c) for c in docs.columns])
