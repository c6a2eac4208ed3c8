"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words of one document. Every window that also starts earlier
(smaller id, or earlier in the same document) is found, and the words it covers are removed.

1. Each window is marked by the smallest hash among its PHRASE-word phrases. Equal windows have
   equal marks, and neighbouring windows mostly share one, so a document has a mark for about
   eight words. Marks meet by hash, packed, in one shuffle; those that recur pass on their places
   and a route, the stretch of text where the mark first stands. Marks that a sample of documents
   shows to be frequent (at most MOST_HOT of them) are known to recur and don't travel at all.
2. Stretches of text whose windows have recurring marks are sent to the task of their route, so
   that all places of a window meet. A task confirms which windows recur, word for word, compiles
   them to an Aho-Corasick automaton over words (a shard of the whole dictionary), streams the
   stretches through it and so locates every occurrence; all but the first are reported. It does
   so for whole routes at a time, BATCH words or a little more.
3. A route with more words than a batch (a passage that very many documents share) is split: its
   windows are grouped by their words, after a task has united its own equals, which gives the
   route's confirmed dictionary with first places; that is shipped to each of the route's parts.
4. The words that the reported windows cover are removed from the documents that have any. Those
   documents' texts are bucketed by id, so only the places of covered words are shuffled for it.

Documents whose whole word sequences are equal are told by a digest beforehand: all but the
first lose every word if they have WINDOW words or more, and take no further part.

Null and empty texts have no words. Rows that repeat an id and its words count as one document and
get the same result. Rows of one id with different words, and rows with a null id (before all
others), are documents of their own, in order of (id, digest of the words). An empty table gives an
empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, checkpointed, delete, join_hot, run_hashes, scratch_path, slices, word_spans

WINDOW, PHRASE = 20, 5
#: Words of a document that one route covers, and words that a task holds at a time (but for a longer single route).
STRETCH, BATCH = 512, 200_000
#: Marks of a bucket, and marks that a task packs at a time.
BUCKET_MARKS, PACK_MARKS = 1_000_000, 1_500_000
#: One document in so many is asked for frequent marks; a mark with so many places there is frequent; at most so many are.
HOT_SAMPLE, HOT_PLACES, MOST_HOT = 16, 32, 1 << 16
#: Bytes of text of a bucket of the documents that have recurring marks.
BUCKET_BYTES = 64 << 20

_SCAN = "doc_id long, n_words long, whole binary"
_SPOT = "doc_id long, start int, n int, route long"
_SPOT_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("route", pa.int64())])


def window_marks(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the phrase that marks each window of a document (the first, if several are smallest), from the hashes of its words."""
    if len(word) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    phrase = np.zeros(len(word) - PHRASE + 1, np.uint64)
    for k in range(PHRASE):
        phrase = phrase * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - PHRASE + 1 + k]
    phrase ^= phrase >> np.uint64(31)
    phrase *= np.uint64(0x94D049BB133111EB)
    phrase ^= phrase >> np.uint64(29)
    span, least, have = WINDOW - PHRASE + 1, np.arange(len(phrase)), 1
    while have < span:
        step = min(have, span - have)
        left, right = least[:-step], least[step:]
        least = np.where(phrase[left] <= phrase[right], left, right)
        have += step
    return least, phrase[least]


def _runs(place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and mark of the runs of windows that are marked by one phrase at one place. Equal windows are never in one run, as their phrases stand apart."""
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(mark) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(mark)]), mark[start]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, number of words, digest of the words."""
    for batch in batches:
        n_words, whole = [], []
        for text in batch.column(1):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n_words.append(len(words))
            whole.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(whole, pa.binary())], ["doc_id", "n_words", "whole"])


def _marked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc_id, start, n and mark of all runs of windows of the batch's texts."""
    parts = []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
        start, n, mark = _runs(*window_marks(run_hashes(raw, *word_spans(raw))))
        parts.append((np.full(len(start), doc_id, np.int64), start, n, mark))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def routes(doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The route of marks that first stand there: one for each STRETCH words of a document."""
    h = doc_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (start // STRETCH).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(27))).view(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers, as planes of bytes: a compressor finds the empty ones."""
    out = [np.uint32(len(columns[0])).tobytes()]
    for x in columns:
        least = int(x.min()) if len(x) else 0
        planes = (x.astype(np.int64) - least).astype("<i8").view(np.uint8).reshape(-1, 8)
        used = max(1, -(-int(int(x.max()) - least).bit_length() // 8)) if len(x) else 1
        out.append(np.array([least, used], "<i8").tobytes() + np.ascontiguousarray(planes[:, :used].T).tobytes())
    return b"".join(out)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<u4", 1)[0]), 4, []
    for _ in range(columns):
        least, used = np.frombuffer(blob, "<i8", 2, at).tolist()
        at += 16
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :used] = np.frombuffer(blob, np.uint8, n * used, at).reshape(used, n).T
        at += n * used
        out.append(planes.view("<i8")[:, 0] + least)
    return out


def _packed(buckets: int, hot: object) -> object:
    """Documents -> (bucket, hot, blob). A cold blob: marks of a bucket (40 bits beside the bucket's), ascending by difference, and their places. A hot blob: places and routes."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, start, n, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
        marks, route = hot.value
        at = np.minimum(np.searchsorted(marks, mark), max(len(marks) - 1, 0))
        known = marks[at] == mark if len(marks) else np.zeros(len(mark), bool)
        bucket, rest = (mark % np.uint64(buckets)).astype(np.int64), (mark >> np.uint64(24)).astype(np.int64)
        rows: list[tuple[int, bool, bytes]] = []
        cold = np.flatnonzero(~known)
        cold = cold[np.lexsort((rest[cold], bucket[cold]))]
        for own in np.split(cold, np.flatnonzero(np.diff(bucket[cold])) + 1):
            if len(own):
                rows.append((int(bucket[own[0]]), False, pack(np.diff(rest[own], prepend=0), doc[own], start[own], n[own])))
        warm = np.flatnonzero(known)
        for own in np.array_split(warm, -(-len(warm) // 65536) or 1):
            if len(own):
                rows.append((int(doc[own[0]] % buckets), True, pack(doc[own], start[own], n[own], route[at[own]] >> np.int64(32), route[at[own]] & np.int64(0xFFFFFFFF))))
        for i in range(0, len(rows), 64):
            b, h, blob = zip(*rows[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(h), pa.array(blob, pa.binary())], ["bucket", "hot", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_marked(batch))
            n += len(held[-1][0])
            if n >= PACK_MARKS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blobs of one bucket -> places of its marks that stand in two places or more, with their routes."""

    def spots(doc: np.ndarray, start: np.ndarray, n: np.ndarray, route: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(doc), 100_000):
            own = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(start[own].astype(np.int32)), pa.array(n[own].astype(np.int32)), pa.array(route[own])], schema=_SPOT_ARROW)

    parts: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for bucket, hot, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if hot:
                doc, start, n, high, low = unpack(blob, 5)
                yield from spots(doc, start, n, high << np.int64(32) | low)
            else:
                rest, doc, start, n = unpack(blob, 4)
                parts.setdefault(bucket, []).append([np.cumsum(rest), doc, start.astype(np.int32), n.astype(np.int8)])
    for bucket in list(parts):
        rest, doc, start, n = (np.concatenate(x) for x in zip(*parts.pop(bucket), strict=True))
        order = np.argsort(rest, kind="stable")
        same = rest[order[1:]] == rest[order[:-1]]
        order = order[np.r_[False, same] | np.r_[same, False]]
        order = order[np.lexsort((start[order], doc[order], rest[order]))]
        rest, doc, start, n = rest[order], doc[order], start[order], n[order]
        begin = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]]) if len(rest) else np.zeros(0, np.int64)
        first = np.repeat(begin, np.diff(np.r_[begin, len(rest)]))
        yield from spots(doc, start, n, routes(doc[first], start[first]))


def _hot_marks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent marks, ascending, and their routes: at most MOST_HOT, counted over a hashed share of all documents. That only says which marks needn't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, _, mark = _marked(batch)
            yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int64))], ["mark", "doc_id", "start"])

    some = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("hot marks")), F.lit(HOT_SAMPLE)) == 0).mapInArrow(run, "mark long, doc_id long, start long")
    counts = checkpointed(some.groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).filter(F.col("n") >= HOT_PLACES))
    least = max(HOT_PLACES - 1, (counts.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    found = [(r.mark, r.first.doc_id, r.first.start) for r in counts.filter(F.col("n") > least).collect()]
    mark, doc, start = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    order = np.argsort(mark.view(np.uint64))
    return mark.view(np.uint64)[order], routes(doc, start)[order]


def _stretches(hot: bool) -> object:
    """Candidate documents -> route, parts, doc_id, start, text: runs of windows with recurring marks of one route, one after another; of split routes, or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, spots in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().split()
                open_at = open_to = open_key = None
                for s in [*sorted(((s["start"], s["n"], s["route"], s["parts"]) for s in spots if (s["parts"] > 0) == hot)), None]:
                    if s is not None and s[2:] == open_key and s[0] == open_to:
                        open_to += s[1]
                        continue
                    if open_key is not None:
                        for col, x in zip(out, (*open_key, doc_id, open_at, b" ".join(words[open_at : open_to + WINDOW - 1]).decode()), strict=True):
                            col.append(x)
                    if s is not None:
                        open_at, open_to, open_key = s[0], s[0] + s[1], s[2:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["route", "parts", "doc_id", "start", "text"])

    return run


def _letters(codes: np.ndarray) -> str:
    """A letter for each code, the surrogates left out."""
    return np.where(codes < 0xD7FF, codes + 1, codes + 2049).astype("<u4").tobytes().decode("utf-32-le")


def _rolled(codes: np.ndarray) -> np.ndarray:
    """A hash of each window of word codes."""
    n = len(codes) - WINDOW + 1
    roll = np.zeros(max(n, 0), np.uint64)
    for k in range(WINDOW if n > 0 else 0):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k].astype(np.uint64)
    return roll ^ (roll >> np.uint64(31))


def _covered(automaton: ahocorasick.Automaton, text: str, place: object) -> Iterator[tuple[int, int]]:
    """Begins and ends of the words that windows of the automaton cover, but those whose first place is this one. place: from a start in text to a place."""
    a = b = -1
    for end, first in automaton.iter(text):
        i = end - WINDOW + 1
        if first == place(i):
            continue
        if i > b:
            if b >= 0:
                yield a, b
            a = i
        b = end + 1
    if b >= 0:
        yield a, b


def _locate(rows: list[tuple[int, int, int, list[str]]]) -> Iterator[tuple[int, int, int]]:
    """(route, doc_id, start, words) in order, whole routes -> (doc_id, start, end) of the words that repeated windows cover."""
    number: dict[str, int] = {}
    codes = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for *_, words in rows]
    hashes = [_rolled(c) for c in codes]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    # Only windows whose hash recurs can recur; whether they do is decided by their words.
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    maybe = np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(flat) else order
    stops = np.cumsum([len(h) for h in hashes])
    row = np.searchsorted(stops, maybe, "right")
    letters: dict[int, str] = {}
    first: dict[str, tuple[int, int]] = {}
    again: set[str] = set()
    for r, i in zip(row.tolist(), (maybe - (stops - [len(h) for h in hashes])[row]).tolist() if len(maybe) else (), strict=True):
        if (s := letters.get(r)) is None:
            s = letters[r] = _letters(codes[r])
        w = s[i : i + WINDOW]
        if first.setdefault(w, (r, i)) != (r, i):
            again.add(w)
    if again:
        automaton = ahocorasick.Automaton()
        for w in again:
            automaton.add_word(w, first[w])
        automaton.make_automaton()
        for r, s in letters.items():
            _, doc_id, start, _ = rows[r]
            for a, b in _covered(automaton, s, lambda i, r=r: (r, i)):
                yield doc_id, start + a, start + b


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by route, document and start -> covered words. Whole routes are taken together."""
    held, words = [], 0

    def flush() -> pa.RecordBatch:
        found = list(_locate(held))
        cols = list(zip(*found, strict=True)) if found else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "a", "b"])

    for batch in batches:
        for route, doc_id, start, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if words >= BATCH and held[-1][0] != route:
                yield flush()
                held, words = [], 0
            held.append((route, doc_id, start, text.split(" ")))
            words += len(held[-1][3])
    yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of split routes -> route, window, first place, number of places: each different window of a slice once."""
    for batch in batches:
        texts = batch.column(3)
        for a, b in slices((len(t.as_buffer()) for t in texts), 1 << 20):
            found: dict[tuple[int, str], list] = {}
            for route, doc_id, start, text in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(4)), strict=True):
                words = text.split(" ")
                for i in range(len(words) - WINDOW + 1):
                    place = (doc_id, start + i)
                    own = found.setdefault((route, " ".join(words[i : i + WINDOW])), [place, 0])
                    own[0] = min(own[0], place)
                    own[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found]), pa.array([v[0][0] for v in found.values()], pa.int64()), pa.array([v[0][1] for v in found.values()], pa.int32()), pa.array([v[1] for v in found.values()], pa.int64())], ["route", "window", "doc_id", "start", "n"])


def _stream(key: tuple, stretches: pa.Table, dictionary: pa.Table) -> pa.Table:
    """One part of a split route, and the route's dictionary: an automaton of its windows, through which the part's stretches run."""
    out: list[list[int]] = [[], [], []]
    if stretches.num_rows and dictionary.num_rows:
        number: dict[str, int] = {}
        automaton = ahocorasick.Automaton()
        for window, doc_id, start in zip(*(dictionary[c].to_pylist() for c in ("window", "doc_id", "start")), strict=True):
            automaton.add_word(_letters(np.array([number.setdefault(w, len(number)) for w in window.split(" ")])), (doc_id, start))
        automaton.make_automaton()
        other = len(number)
        for doc_id, start, text in zip(*(stretches[c].to_pylist() for c in ("doc_id", "start", "text")), strict=True):
            s = _letters(np.array([number.get(w, other) for w in text.split(" ")]))
            for a, b in _covered(automaton, s, lambda i, doc_id=doc_id, start=start: (doc_id, start + i)):
                for col, x in zip(out, (doc_id, start + a, start + b), strict=True):
                    col.append(x)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "a", "b"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, sha = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.encode().split()
            cover = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                cover[s["a"]] += 1
                cover[s["b"]] -= 1
            keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
            removed.append(len(words) - len(keep))
            sha.append(hashlib.sha256(b" ".join([words[i] for i in keep])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_removed", "kept_sha256"])


class _Scratch:
    """Tables in the shared folder that are deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """df, which is partitioned by key into n, as a table bucketed so: joins by key needn't shuffle it again."""
        path, name = scratch_path(self.spark, "bucketed"), f"tessera_{uuid.uuid4().hex}"
        self.paths.append(path)
        self.names.append(name)
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
        return self.spark.table(name)

    def delete(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, *self.paths)


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, whole and first_id (the smallest id with these words) of every row."""
    scan = checkpointed(rows.mapInArrow(_scan, _SCAN))
    return checkpointed(join_hot(scan, scan.groupBy("whole").agg(F.min("doc_id").alias("first_id")), "whole").select("doc_id", "n_words", "whole", "first_id"))


def covered(rows: DataFrame, classes: DataFrame, scratch: _Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents with recurring marks (doc_id, text, bucketed by doc_id), and the covered words (doc_id, a, b) that repeat earlier text."""
    spark = rows.sparkSession
    words = classes.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-words // (8 * BUCKET_MARKS)))
    hot = spark.sparkContext.broadcast(_hot_marks(rows))
    blobs = rows.mapInArrow(_packed(buckets, hot), "bucket int, hot boolean, blob binary")
    spots = scratch.written(blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(_recurring, _SPOT), "spots")
    firsts = classes.filter("doc_id = first_id").select("doc_id").distinct()
    # Routes with more words than a batch (or than an even share of HOT_KEYS routes): at most HOT_KEYS of them.
    sizes = checkpointed(spots.groupBy("route").agg(F.sum("n").alias("words")))
    most = max(BATCH, (sizes.agg(F.sum("words")).first()[0] or 0) // HOT_KEYS)
    split = sizes.filter(F.col("words") > most).select("route", F.ceil(F.col("words") / most).cast("int").alias("parts"))
    routed = spots.join(F.broadcast(split), "route", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    n = min(100_000, max(2, -(-words * 7 // BUCKET_BYTES)))
    places = routed.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "route", "parts")).alias("spots")).join(firsts, "doc_id", "left_semi")
    whole = rows.repartition(n, "doc_id").join(places, "doc_id").select("doc_id", "text", "spots").dropDuplicates(["doc_id"])
    candidates = scratch.bucketed(whole, "doc_id", n)
    kind = "route long, parts int, doc_id long, start int, text string"
    order = ["route", "doc_id", "start"]
    stretches = candidates.select("doc_id", "text", "spots").mapInArrow(_stretches(False), kind).select(*order, "text")
    found = stretches.repartition("route").sortWithinPartitions(*order).mapInArrow(_find, "doc_id long, a int, b int")
    if split.head(1):
        shared = candidates.select("doc_id", "text", "spots").filter(F.exists("spots", lambda s: s["parts"] > 0))
        shared = scratch.written(shared.mapInArrow(_stretches(True), kind), "shared")
        window = shared.select(*order, "text").mapInArrow(_windows, "route long, window string, doc_id long, start int, n long")
        many = window.groupBy("route", "window").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.sum("n").alias("n")).filter("n > 1")
        dictionary = scratch.written(many.select("route", "window", "first.doc_id", "first.start"), "dictionary")
        sent = dictionary.join(F.broadcast(split), "route").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        dealt = shared.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
        found = found.union(dealt.groupBy("route", "part").cogroup(sent.groupBy("route", "part")).applyInArrow(_stream, "doc_id long, a int, b int"))
    return candidates.select("doc_id", "text"), found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """doc_id and text with one text an id, their classes, and (doc_id, own_id) where ids had to be given anew."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes = _classes(rows)
    mixed = classes.groupBy("doc_id").agg((F.min("whole") != F.max("whole")).alias("mixed")).filter("mixed or doc_id is null")
    if not mixed.head(1):
        return rows, classes, None

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = next(_scan(iter([batch]))).column(2)
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], ["doc_id", "text", "whole"])

    # Places in the order of (id, digest): they rise with the partition of a sorted table.
    places = checkpointed(classes.select("doc_id", "whole").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "whole").withColumn("place", F.monotonically_increasing_id()))
    own = rows.mapInArrow(digests, "doc_id long, text string, whole binary").alias("own").join(places.alias("p"), F.expr("own.doc_id <=> p.doc_id and own.whole = p.whole")).select(F.col("place").alias("doc_id"), "own.text")
    own = own.persist(StorageLevel.DISK_ONLY)
    return own, _classes(own), places.select(F.col("place").alias("doc_id"), F.col("doc_id").alias("own_id"))


def _named(out: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The result under the ids that the input had."""
    return out if ids is None else out.join(ids, "doc_id").select(F.col("own_id").alias("doc_id"), *[c for c in out.columns if c != "doc_id"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    scratch = _Scratch(docs.sparkSession)
    rows, classes, ids = _rows(docs, id_col, text_col)
    candidates, found = covered(rows, classes, scratch)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = spans.join(candidates, "doc_id").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_removed long, kept_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    copy = (F.col("doc_id") != F.col("first_id")) & (F.col("n_words") >= WINDOW)
    out = classes.join(cut, "doc_id", "left").select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"))
    out = checkpointed(_named(out, ids))
    scratch.delete()
    return out


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the kept words joined by a space, one row per row of docs that keeps all or some of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = {i for s in spans or () for i in range(s["a"], s["b"])}
                texts.append(b" ".join([w for i, w in enumerate(words) if i not in gone]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    scratch = _Scratch(docs.sparkSession)
    rows, classes, ids = _rows(docs, id_col, text_col)
    _, found = covered(rows, classes, scratch)
    spans = checkpointed(found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    scratch.delete()
    copies = classes.filter((F.col("doc_id") != F.col("first_id")) & (F.col("n_words") >= WINDOW)).select("doc_id").distinct()
    kept = rows.join(copies, "doc_id", "left_anti").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")
    return _named(kept, ids)
