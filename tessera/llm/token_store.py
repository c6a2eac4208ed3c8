"""Token ids as a content-addressed store.

Each document's ids, with an end id, are cut into chunks where a rolling hash of the last ids
says so, so equal passages give equal chunks wherever they stand. A chunk is stored once under
its SHA-256. Three tables in one folder, written by Spark and readable from any store:

  packs     digest, n, payload (ids as little-endian unsigned 16- or 32-bit integers), by digest
  recipes   in ascending doc_id order: part, block, doc_id, place (ids of the part before), n_tokens, root, chunks (digests in order)
  manifest  one row per block of recipes: part, block, n_docs, n_tokens, root
  parts     one row per part of recipes: part, n_blocks, n_tokens, start, root

A document's root is the Merkle root of its chunks' digests, a block's (BLOCK_DOCS documents) that of
its documents' roots, a part's that of its blocks'; a part is a range of ids that one task writes, and
there are as many as shuffle partitions. Reading verifies every stored chunk against its digest, every recipe
against its root, every block against the manifest and every part against its blocks; a mismatch is
an error.

Null text is an empty text: only the end id. Repeated rows have a recipe each, in any order among
equals. An empty table gives empty tables. Further columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import END, SIMPLE, PieceCache, cache_for, encoded, texts_of
from .common import checkpointed, delete, join_hot, scratch_path, slices, sorted_distinct

END_ID = 1
#: Ids that the rolling hash sees, the bits that must be 0 at a cut (a chunk of 512 ids in the mean), and the longest chunk.
WINDOW, CUT_BITS, LONGEST = 8, 9, 8192
#: Digests a task remembers, so that it doesn't pass on a chunk's payload twice; forgetting them costs space for a while, no correctness.
SEEN = 200_000
#: Documents of a block, whose roots one task gathers (32 bytes each).
BLOCK_DOCS = 4096


class LibraryCache(PieceCache):
    """New pieces are encoded by the tokenizers library. A text that isn't simple is cut at ASCII white space, which no token spans."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        ends = [i for token, i in self.library.get_vocab().items() if token.endswith(END)]
        self.ends_word = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends_word[ends] = True
        super().__init__()

    def split(self, text: str) -> list[bytes]:
        return text.encode().split()

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters go to the library as texts of many words, told apart by the mark at the end of their last token; other pieces one by one."""
        texts = [p.decode() for p in pieces]
        plain = [t.isalpha() and SIMPLE.fullmatch(t) is not None for t in texts]
        words, others = ([t for t, one in zip(texts, plain, strict=True) if one is kind] for kind in (True, False))
        joined = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        flat = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        of_words = np.diff(np.r_[-1, np.flatnonzero(self.ends_word[flat])])
        ids = [e.ids for e in self.library.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.zeros(len(texts), np.int64)
        is_word = np.array(plain, bool)
        lengths[is_word], lengths[~is_word] = of_words, [len(x) for x in ids]
        out = np.zeros(lengths.sum(), np.uint32)
        from_word = np.repeat(is_word, lengths)
        out[from_word], out[~from_word] = flat, [x for own in ids for x in own]
        return out, lengths


@lru_cache(1)
def _mix() -> np.ndarray:
    """A 64-bit hash of each id below 2**16; higher ids take those of their low bits."""
    h = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def cut_points(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents that lie one after another, by content alone: the hash of the last WINDOW ids of the same document decides."""
    h = _mix()[ids & 0xFFFF]
    rolled = h.copy()
    for k in range(1, WINDOW):
        rolled[k:] += h[:-k] << np.uint64(k)
    stops = np.cumsum(counts)
    cuts = np.flatnonzero((rolled >> np.uint64(64 - CUT_BITS)) == 0) + 1
    inside = cuts - (stops - counts)[np.minimum(np.searchsorted(stops, cuts - 1, "right"), len(stops) - 1)] if len(stops) else cuts
    ends = sorted_distinct(np.r_[cuts[inside >= WINDOW], stops[counts > 0]])
    size = np.diff(np.r_[0, ends])
    if len(size) and size.max() > LONGEST:
        more = -(-size // LONGEST)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        ends = np.minimum(np.repeat(ends - size, more) + (step + 1) * LONGEST, np.repeat(ends, more))
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs of neighbours hashed up to one; a last one without a partner goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return hashlib.sha256(b"root" + level[0]).digest()


_LOG = "doc_id long, n_tokens long, chunks array<struct<digest binary, n int, payload binary>>"
_LOG_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])))])


def _cut(docs: DataFrame, path: str, width: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(LibraryCache, path)
        seen: set[bytes] = set()
        for batch in batches:
            for a, b, ids, counts in encoded(cache, texts_of(batch.column(1))):
                counts = counts + 1
                stops = np.cumsum(counts)
                flat = np.insert(ids, np.cumsum(counts - 1), END_ID).astype(width)
                ends = cut_points(flat, counts)
                begins = np.r_[0, ends[:-1]] if len(ends) else ends
                offsets = np.searchsorted(ends, stops, "right")
                raw, wide = flat.tobytes(), flat.itemsize
                digest, payload = [], []
                for start, end in zip((begins * wide).tolist(), (ends * wide).tolist(), strict=True):
                    piece = raw[start:end]
                    d = hashlib.sha256(piece).digest()
                    digest.append(d)
                    payload.append(None if d in seen else piece)
                    seen.add(d)
                if len(seen) > SEEN:
                    seen.clear()
                chunks = pa.ListArray.from_arrays(pa.array(np.r_[0, offsets], pa.int32()), pa.StructArray.from_arrays([pa.array(digest, pa.binary()), pa.array((ends - begins).astype(np.int32)), pa.array(payload, pa.binary())], fields=list(_LOG_ARROW.field("chunks").type.value_type)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), chunks], schema=_LOG_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, _LOG)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest: the first of each, after a full comparison with those that follow."""
    last: tuple[bytes, bytes] = (b"", b"")
    for batch in batches:
        keep = []
        for i, (digest, payload) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if digest != last[0]:
                keep.append(i)
                last = (digest, payload)
            elif payload != last[1]:
                raise ValueError(f"two chunks have the digest {digest.hex()}")
        yield batch.take(pa.array(keep, pa.int64()))


_RECIPE = "part int, block int, doc_id long, place long, n_tokens long, root binary, chunks array<binary>"
_RECIPE_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(pa.binary()))])


def _recipes(block_docs: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, docs = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = start + np.cumsum(n)
            roots = [merkle_root(c) for c in batch.column(2).to_pylist()]
            block = (docs + np.arange(len(n))) // block_docs
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(block.astype(np.int32)), batch.column(0), pa.array(ends - n, pa.int64()), batch.column(1), pa.array(roots, pa.binary()), batch.column(2).cast(pa.list_(pa.binary()))], schema=_RECIPE_ARROW)
            start, docs = int(ends[-1]) if len(ends) else start, docs + len(n)

    return run


def _tree(order: list[str]):
    """The Merkle root of a group's roots, in order of these columns."""
    tree = F.udf(lambda roots: merkle_root([bytes(r) for r in roots]), "binary")
    return tree(F.transform(F.array_sort(F.collect_list(F.struct(*order, "root"))), lambda r: r["root"]))


def block_roots(recipes: DataFrame) -> DataFrame:
    """part, block, n_docs, n_tokens, root: the blocks as read; a task gathers the roots of BLOCK_DOCS documents."""
    return recipes.groupBy("part", "block").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _tree(["place", "doc_id"]).alias("root"))


def part_roots(blocks: DataFrame) -> DataFrame:
    """part, n_blocks, n_tokens, root, from the blocks."""
    return blocks.groupBy("part").agg(F.count("*").alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"), _tree(["block"]).alias("root"))


def write_store(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", width: str = "<u2", block_docs: int = BLOCK_DOCS) -> None:
    """Encode docs and write packs, recipes, manifest and parts under folder. width: <u2 for vocabularies of up to 65,536 ids, else <u4."""
    spark = docs.sparkSession
    log_path = scratch_path(spark, "chunk-log")
    _cut(docs, path, width, id_col, text_col).write.option("compression", "zstd").parquet(log_path)
    log = spark.read.schema(_LOG).parquet(log_path)
    chunk = log.select(F.explode("chunks").alias("c")).select("c.*").filter("payload is not null")
    chunk.repartition("digest").sortWithinPartitions("digest").mapInArrow(_once, "digest binary, n int, payload binary").write.option("compression", "zstd").parquet(f"{folder}/packs")
    recipe = log.select("doc_id", "n_tokens", F.col("chunks.digest").alias("chunks")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    recipe.mapInArrow(_recipes(block_docs), _RECIPE).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    blocks = block_roots(spark.read.schema(_RECIPE).parquet(f"{folder}/recipes"))
    blocks.write.parquet(f"{folder}/manifest")
    # One row a part: the running sum runs over as many rows as there are partitions.
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = part_roots(spark.read.schema(blocks.schema).parquet(f"{folder}/manifest"))
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).coalesce(1).write.parquet(f"{folder}/parts")
    delete(spark, log_path)


def _crc_tables() -> np.ndarray:
    """tables[k, j, v]: the crc32 state (v << 8j) moved on over 2**k zero bytes."""
    poly = 0xEDB88320
    one = np.zeros(32, np.uint64)  # images of the single bits over one zero byte
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (poly if c & 1 else 0)
        one[bit] = c
    out = np.zeros((40, 4, 256), np.uint64)

    def apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for bit in range(32):
            y ^= np.where((x >> np.uint64(bit)) & np.uint64(1), images[bit], np.uint64(0))
        return y

    for k in range(40):
        for j in range(4):
            out[k, j] = apply(one, np.arange(256, dtype=np.uint64) << np.uint64(8 * j))
        one = apply(one, one)
    return out


def crc_of_parts(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """crc32 of each concatenation, from the crc32 and byte sizes of its parts; counts: parts of each (1 at least)."""
    tables = _crc_tables()
    ends = np.cumsum(counts)
    after = np.cumsum(sizes)
    behind = np.repeat(after[ends - 1], counts) - after
    x = crcs.astype(np.uint64)
    for k in range(int(behind.max()).bit_length() if len(behind) else 0):
        on = np.flatnonzero((behind >> k) & 1)
        v = x[on]
        x[on] = tables[k, 0][v & np.uint64(255)] ^ tables[k, 1][(v >> np.uint64(8)) & np.uint64(255)] ^ tables[k, 2][(v >> np.uint64(16)) & np.uint64(255)] ^ tables[k, 3][v >> np.uint64(24)]
    return np.bitwise_xor.reduceat(x, ends - counts) if len(counts) else x


def verified_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes with their place in the whole stream: doc_id, start, n_tokens, root, chunks. Blocks are held against the manifest, parts against their blocks."""
    recipes = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")
    blocks, parts = (spark.read.parquet(f"{folder}/{name}") for name in ("manifest", "parts"))
    seen = block_roots(recipes).join(blocks.withColumnRenamed("root", "want").select("part", "block", "want"), ["part", "block"], "full_outer")
    seen = seen.withColumn("fits", F.coalesce(F.col("root") == F.col("want"), F.lit(False)))
    found = part_roots(seen).join(seen.groupBy("part").agg(F.min("fits").alias("fits")), "part")
    found = found.select(F.col("part").alias("found_part"), F.col("root").alias("found"), "fits")
    # One row a part, as many as the writer had partitions, so they may be broadcast.
    checked = checkpointed(parts.join(found, F.col("part") == F.col("found_part"), "full_outer").select("part", "start", F.coalesce(F.col("fits") & (F.col("root") == F.col("found")), F.lit(False)).alias("fits")))
    if checked.filter("not fits").head(1):
        raise ValueError("recipes differ from the manifest")
    return recipes.join(F.broadcast(checked), "part").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "root", "chunks")


def chunk_sums(spark: SparkSession, folder: str, width: str = "<u2") -> DataFrame:
    """digest, n, crc: every stored chunk, read whole and held against its digest. crc: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"the chunk {digest.hex()} differs from its digest")
                crc.append(zlib.crc32(np.frombuffer(payload, width).astype("<u4").tobytes()))
            n = [len(p) // np.dtype(width).itemsize for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return spark.read.parquet(f"{folder}/packs").select("digest", "payload").mapInArrow(run, "digest binary, n long, crc long")


def _parts(recipes: DataFrame) -> DataFrame:
    return recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("place", "digest"))


def read_sums(spark: SparkSession, folder: str, width: str = "<u2") -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32. A chunk is read and summed once, however many documents have it; a document's sum is put together from its chunks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(4).to_pylist()
            for root, own, n in zip(batch.column(3).to_pylist(), parts, batch.column(2).to_pylist(), strict=True):
                if merkle_root([p["digest"] for p in own]) != root or sum(p["n"] for p in own) != n:
                    raise ValueError("a document can't be put together as its recipe says")
            flat = [(p["crc"], 4 * p["n"]) for own in parts for p in own]
            crc, size = (np.array(x, np.int64) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 2
            total = crc_of_parts(crc, size, np.array([len(own) for own in parts], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = join_hot(_parts(verified_recipes(spark, folder)), chunk_sums(spark, folder, width), "digest", "left")
    whole = joined.groupBy("doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("place", "digest", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc")))).alias("parts"))
    return whole.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str, width: str = "<u2") -> DataFrame:
    """One row per document, from the files: doc_id, start, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(3).to_pylist()
            for a, b in slices(sum(len(p["payload"] or b"") for p in own) for own in parts):
                ids = []
                for root, own in zip(batch.column(2).to_pylist()[a:b], parts[a:b], strict=True):
                    if merkle_root([p["digest"] for p in own]) != root or any(p["payload"] is None or hashlib.sha256(p["payload"]).digest() != p["digest"] for p in own):
                        raise ValueError("a document can't be put together as its recipe says")
                    ids.append(np.frombuffer(b"".join(p["payload"] for p in own), width).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["doc_id", "start", "ids"])

    packs = spark.read.parquet(f"{folder}/packs").select("digest", "payload")
    joined = join_hot(_parts(verified_recipes(spark, folder)), packs, "digest", "left")
    whole = joined.groupBy("doc_id", "start", "root").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "payload"))).alias("parts"))
    return whole.select("doc_id", "start", "root", "parts").mapInArrow(run, "doc_id long, start long, ids array<int>")
