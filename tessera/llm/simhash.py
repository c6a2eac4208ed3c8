"""SimHash near-dedup by anchor-point covering.

Fingerprints that link differ in at most DISTANCE bits. The 64 bits are cut into blocks with a
distance each, so that a linked pair is within it in one block at least (the sum of the blocks'
distances plus one each exceeds DISTANCE). In a block, anchors are the code words of a covering
code: the perfect binary Golay code of length 23 with covering radius 3, with further bits as they
are (radius 0). A fingerprint's home is the anchor nearest to it, within the covering radius; it is
also sent to every anchor within covering radius plus the block's distance. Wherever the homes'
fingerprints meet those sent, a pair is compared once over all 64 bits. So no link is lost.

Equal fingerprints are one row before anything is sent. Anchors with many rows are dealt to
several tasks: home rows in parts, those sent to each part. A task keeps the links that join
its groups anew, not all pairs. The layout of blocks follows the number of fingerprints, so
that rows an anchor stay few; every layout finds the same links.

Null and empty texts have no words and fingerprint zero, which links like any other. Texts of
fewer than four words are one shingle. Repeated rows have one fingerprint and one component.
An empty table gives an empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import HOT_KEYS, checkpointed, join_hot, rows_with_ids
from .components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42

#: Layouts: (from so many fingerprints, blocks). A block: first bit, Golay bits (23 or 0), further bits, distance.
LAYOUTS = (
    (0, ((0, 23, 0, 1), (23, 23, 0, 1), (46, 0, 18, 0))),
    (20_000_000, ((0, 23, 6, 2), (29, 23, 12, 1))),
)
#: Rows of an anchor that one task compares; an anchor with more home rows is dealt to several.
PART = 4096


def fingerprint(text: str) -> int:
    """64 bits; a bit is 1 if it is 1 in over half the hashes of the text's word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    k = min(SHINGLE, len(words))
    pairs = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), F.xxhash64(text_col)).mapInArrow(run, "doc_id long, fp long, text_hash long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The words of the perfect Golay code of length 23, and for each of the 2**11 syndromes its error of weight up to 3. Polynomial x^11+x^10+x^6+x^5+x^4+x^2+1."""
    poly = 0b110001110101

    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where((x >> bit) & 1, x ^ (poly << (bit - 11)), x)
        return x

    data = np.arange(1 << 12, dtype=np.int64) << 11
    errors = [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i)), *(1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j))]
    leader = np.zeros(1 << 11, np.int64)
    leader[remainder(np.array(errors, np.int64))] = errors
    return data | remainder(data), leader


def _syndrome(x: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (0b110001110101 << (bit - 11)), x)
    return x


@lru_cache(8)
def _around(distance: int) -> list[list[np.ndarray]]:
    """For each syndrome and excess 0..distance: what to add to a word so as to get its anchors at 3 + excess (3 or less for 0)."""
    words, leader = golay()
    weight = np.bitwise_count(words)
    out: list[list[np.ndarray]] = []
    for e in leader.tolist():
        d = np.bitwise_count(words ^ e).astype(np.int64)
        near = [(words ^ e)[d <= 3]] + [(words ^ e)[d == 3 + x] for x in range(1, distance + 1)]
        out.append(near)
    assert weight.min() == 0
    return out


@lru_cache(8)
def _flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks of 0, 1 ... most of so many bits."""
    from itertools import combinations

    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), n)], np.int64) for n in range(most + 1)]


def anchors(fp: np.ndarray, block: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is the row's home, for all anchors within covering radius plus distance of each fingerprint in the block."""
    first, coded, plain, distance = block
    x = (fp >> np.uint64(first)).astype(np.int64) & ((1 << coded + plain) - 1)
    head, tail = x & ((1 << coded) - 1), x >> coded
    flips = _flips(plain, distance) if plain else [np.zeros(1, np.int64)]
    if not coded:
        masks = np.concatenate(flips)
        at = np.repeat(np.arange(len(fp)), len(masks))
        return at, (tail[:, None] ^ masks[None]).ravel(), np.tile(masks == 0, len(fp))
    near = _around(distance)
    syndrome = _syndrome(head)
    rows, found, home = [], [], []
    order = np.argsort(syndrome, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(syndrome[order])) + 1):
        if not len(own):
            continue
        for excess, adds in enumerate(near[syndrome[own[0]]]):
            for n, masks in enumerate(flips):
                if excess + n > distance or not len(adds):
                    continue
                a = head[own][:, None, None] ^ adds[None, :, None]
                t = tail[own][:, None, None] ^ masks[None, None, :]
                both = (a | (t << coded)).reshape(len(own), -1)
                rows.append(np.repeat(own, both.shape[1]))
                found.append(both.ravel())
                home.append(np.full(both.size, excess == 0 and n == 0))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _send(blocks: tuple) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(a, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                for i, block in enumerate(blocks):
                    row, anchor, home = anchors(fp, block)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor * len(blocks) + i), pa.array(home), pa.array(fp[row].view(np.int64))], ["anchor", "home", "fp"])

    return run


class _Groups:
    """Union-find over the fingerprints of one task's group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y] if y in self.up else y
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links_between(home: np.ndarray, sent: np.ndarray, distance: int = DISTANCE, groups: _Groups | None = None) -> list[tuple[int, int]]:
    """Links of home fingerprints and those sent that join groups anew; the pairs themselves aren't kept."""
    groups, out = _Groups() if groups is None else groups, []
    step = max(1, (1 << 20) // max(1, len(sent)))
    for a in range(0, len(home), step):
        near = np.bitwise_count(home[a : a + step, None] ^ sent[None]) <= distance
        i, j = np.nonzero(near)
        x, y = home[a + i], sent[j]
        differ = x != y
        for p, q in zip(x[differ].tolist(), y[differ].tolist(), strict=True):
            if groups.join(p, q):
                out.append((p, q))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and part, home rows first -> links. Holds a part's home rows (PART and some) and compares what was sent as it comes."""
    key, homes, home, groups = None, [], None, _Groups()

    def links(sent: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = links_between(home, sent, groups=groups)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*found, strict=True)], ["a", "b"])

    def close() -> Iterator[pa.RecordBatch]:
        """All home rows are there: they meet each other."""
        nonlocal homes, home
        if homes and home is None:
            home = np.concatenate(homes)
            yield from links(home)

    for batch in batches:
        anchor, part, own, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (own[1:] != own[:-1])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(fp)], strict=True):
            if a == b:
                continue
            if (anchor[a], part[a]) != key:
                yield from close()
                key, homes, home, groups = (anchor[a], part[a]), [], None, _Groups()
            if own[a]:
                homes.append(fp[a:b])
            elif homes:
                yield from close()
                yield from links(fp[a:b])
    yield from close()


def fingerprint_links(distinct: DataFrame, part: int = PART, layouts=LAYOUTS) -> DataFrame:
    """distinct: fp, all different -> links (a, b) whose components are those of all pairs within DISTANCE bits."""
    n = distinct.count()
    blocks = [b for least, b in layouts if n >= least][-1]
    sent = distinct.select("fp").mapInArrow(_send(blocks), "anchor long, home boolean, fp long")
    # Anchors with more home rows than a part: at most n * blocks / part of them.
    hot = checkpointed(distinct.select("fp").mapInArrow(_send_home(blocks), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > part).select("anchor", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    # Their rows stay where they are until they are dealt to parts, as long as the hot anchors are few enough to be broadcast.
    dealt = sent.join(F.broadcast(hot) if hot.count() <= HOT_KEYS else hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("home", F.col("home") & (own == F.col("part")))
    dealt = dealt.select("anchor", "part", "home", "fp")
    return dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home")).mapInArrow(_compare, "a long, b long")


def _send_home(blocks: tuple) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (first, coded, plain, _) in enumerate(blocks):
                _, anchor, _ = anchors(fp, (first, coded, plain, 0))
                yield pa.RecordBatch.from_arrays([pa.array(anchor * len(blocks) + i)], ["anchor"])

    return run


def _of_prints(prints: DataFrame, part: int = PART, layouts=LAYOUTS) -> DataFrame:
    """fp, component (a fingerprint that names it), component_id (its smallest id; null if all are)."""
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = components(fingerprint_links(classes, part, layouts))
    named = checkpointed(classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return checkpointed(join_hot(named, least, "component").select("fp", "component", "component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, layouts=LAYOUTS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable; nulls aside)."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    return join_hot(prints, _of_prints(prints, part, layouts), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that of the smallest id (null last, then by a hash of the text), all columns as they were."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    stay = join_hot(prints, _of_prints(prints).select("fp", "component"), "fp").groupBy("component").agg(first)
    return rows_with_ids(docs, stay.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("text_hash")), id_col, text_col)
