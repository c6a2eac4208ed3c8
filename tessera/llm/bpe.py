"""BPE encoding and decoding with a public vocabulary file, merged in batched numpy rounds.

The merge loop is numpy: the symbols of many words lie in one flat array, the rank of every
neighbouring pair is found by binary search over the sorted pair keys, and each round merges the
lowest-ranked pair of every word that still has one. Only words that a worker hasn't met are
merged; their ids stay in a cache of bounded size. Texts of ASCII and Latin-1 letters are split by
the vocabulary's pattern; other texts are normalised and split by the tokenizers library itself,
so that Unicode versions can't differ.

Null and empty texts have no ids. Rows are independent: repeated rows and ties need no rule.
Texts are taken in slices of bounded size; a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_hashes, slices

#: Fixed values of the vocabulary's file format: the mark at the end of a word.
END = "</w>"
#: Texts of ASCII and Latin-1 letters need no normal form, and lower case is the same for all.
SIMPLE = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*+")

#: Pieces a worker remembers; beyond that it forgets them all.
CACHE_PIECES = 800_000
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    keep = set(shown)
    return [chr(b if b in keep else next(hidden)) for b in range(256)]


class Vocabulary:
    """Pair keys, ranks and results of the merges, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.size = size
        symbols = byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.last = np.array([ids[c + END] for c in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in merges), strict=True))
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        # A merge is plain if no pair with its result ranks before it: then all its places in a word can merge in one round.
        lowest = np.full(size, NO_RANK, np.int64)
        np.minimum.at(lowest, left, np.arange(len(keys)))
        np.minimum.at(lowest, right, np.arange(len(keys)))
        self.plain = lowest[self.made] > self.ranks
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NO_RANK if there is none, and its place among the sorted keys."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), at


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the number of ids of each. Words aren't empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbol = vocabulary.inner[raw]
    ends = np.cumsum(lengths)
    symbol[ends - 1] = vocabulary.last[raw[ends - 1]]
    word = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    # rank[i], place[i]: of the pair that begins at symbol i; a word's last symbol begins none.
    inside = np.flatnonzero(word[:-1] == word[1:])
    rank, place = np.full(len(symbol), NO_RANK, np.int32), np.zeros(len(symbol), np.int32)
    rank[inside], place[inside] = vocabulary.find(symbol[inside], symbol[inside + 1])
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        counts = np.diff(np.r_[starts, len(symbol)])
        lowest = np.minimum.reduceat(rank, starts)
        best = np.repeat(lowest, counts)
        if (lowest == NO_RANK).any():
            live = best != NO_RANK
            done.append((word[~live], symbol[~live]))
            symbol, word, rank, place, best = symbol[live], word[live], rank[live], place[live], best[live]
            if not len(symbol):
                break
        hit = np.flatnonzero(rank == best)
        first = np.r_[True, word[hit][1:] != word[hit][:-1]]
        if not first.all():
            # Where hits touch, as in a a a, every second one of the row merges, from the left.
            row = np.cumsum(np.r_[True, np.diff(hit) != 1])
            begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            take = (np.arange(len(hit)) - np.repeat(begins, np.diff(np.r_[begins, len(hit)]))) % 2 == 0
            hit = hit[take & (vocabulary.plain[place[hit]] | first)]
        symbol[hit] = vocabulary.made[place[hit]]
        stay = np.ones(len(symbol), bool)
        stay[hit + 1] = False
        hit = hit - np.arange(len(hit))  # each merge before it took one symbol away
        symbol, word, rank, place = symbol[stay], word[stay], rank[stay], place[stay]
        # Only pairs on either side of a merge are new.
        new = np.r_[hit[hit > 0] - 1, hit]
        rank[new] = NO_RANK
        new = new[new + 1 < len(symbol)]
        new = new[word[new] == word[new + 1]]
        rank[new], place[new] = vocabulary.find(symbol[new], symbol[new + 1])
    word, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
    order = np.argsort(word, kind="stable")
    return symbol[order].astype(np.uint32), np.bincount(word, minlength=len(words))


def _classes() -> np.ndarray:
    """Class of each byte of lower-cased simple text: 0 white space, 1 letter, 2 digit, 3 other. Bytes over 127 only occur in letters."""
    kind = np.full(256, 3, np.uint8)
    kind[list(b" \t\n\x0b\x0c\r")] = 0
    kind[list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = 1
    kind[list(range(ord("0"), ord("9") + 1))] = 2
    return kind


_KIND = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Fixed values of the vocabulary's split pattern: what may follow an apostrophe in a piece.
_SHORT, _LONG = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")


def cut_simple(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begins and ends of the pieces of simple texts, which are separated by white space."""
    low = _LOWER[raw]
    capital = np.flatnonzero(raw[:-1] == 0xC3) + 1
    capital = capital[(low[capital] < 0x9F) & (low[capital] != 0x97)]
    low[capital] += 32
    kind = _KIND[low]
    start = np.r_[True, kind[1:] != kind[:-1]] | (kind == 2)
    mark = np.flatnonzero(low == ord("'"))
    if len(mark):
        mark = mark[start[mark]]
        after = np.r_[low, np.zeros(2, np.uint8)]
        one, two = after[mark + 1], after[mark + 2]
        short = np.isin(one, [x[0] for x in _SHORT])
        long = np.zeros(len(mark), bool)
        for x in _LONG:
            long |= (one == x[0]) & (two == x[1])
        for at, n in ((mark[short], 2), (mark[long], 3)):
            start[at + 1] = False
            stop = at + n
            start[stop[stop < len(low)]] = True
    begin = np.flatnonzero(start)
    end = np.r_[begin[1:], len(low)]
    word = kind[begin] != 0
    return low, begin[word], end[word]


class PieceCache:
    """Ids of the pieces that a worker has met: ids of piece i are pool[offset[i]:offset[i] + length[i]].

    Pieces are found by a hash table in numpy arrays; a hit is compared byte by byte with the
    piece it stands for. Subclasses say how new pieces are encoded and how a text that isn't
    simple is split.
    """

    BITS = 21

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(1 << self.BITS, np.uint64)
        self.code = np.zeros(1 << self.BITS, np.int32)
        self.known = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.offset, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def split(self, text: str) -> list[bytes]:
        raise NotImplementedError

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def find(self, h: np.ndarray) -> np.ndarray:
        """Code of each hash, -1 if it isn't there."""
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        key = self.key[slot]
        same = key == h
        out[same] = self.code[slot[same]]
        todo = np.flatnonzero(~same & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            key = self.key[slot[todo]]
            same = key == h[todo]
            out[todo[same]] = self.code[slot[todo[same]]]
            todo = todo[~same & (key != 0)]
        return out

    def insert(self, h: np.ndarray, code: np.ndarray) -> None:
        """Hashes that are new and all different."""
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.key[slot[todo]] == 0
            _, first = np.unique(slot[todo], return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            self.key[slot[todo[won]]] = h[todo[won]]
            self.code[slot[todo[won]]] = code[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)

    def learn(self, low: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        flat = low.tobytes()
        pieces = [flat[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ids, lengths = self.encode_new(pieces)
        size = end - begin
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)]
        if self.text_used + len(joined) > len(self.text):
            self.text = np.r_[self.text[: self.text_used], np.zeros(self.text_used + 2 * len(joined), np.uint8)]
        self.pool[self.used : self.used + len(ids)] = ids
        self.text[self.text_used : self.text_used + len(joined)] = joined
        grown = (self.used + np.cumsum(lengths) - lengths, lengths, self.text_used + np.cumsum(size) - size, size)
        self.offset, self.length, self.at, self.size = (np.r_[old, new.astype(np.int32)] for old, new in zip((self.offset, self.length, self.at, self.size), grown, strict=True))
        self.used += len(ids)
        self.text_used += len(joined)
        self.insert(h, np.arange(self.known, self.known + len(pieces), dtype=np.int32))
        self.known += len(pieces)

    def lookup(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Codes of the pieces; new ones are encoded first."""
        h = np.maximum(run_hashes(low, begin, end), np.uint64(1))
        code = self.find(h)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            if self.known + len(missing) > CACHE_PIECES and self.known:
                self.reset()
                return self.lookup(low, begin, end)
            new, first = np.unique(h[missing], return_index=True)
            if self.known + len(new) > 1 << self.BITS - 1:  # a single slice of more pieces than the table is made for
                self.BITS += 1
                self.reset()
                return self.lookup(low, begin, end)
            first = missing[first]
            self.learn(low, new, begin[first], end[first])
            code[missing] = self.find(h[missing])
        # Every piece against the one it was found to be.
        size = end - begin
        differ = self.size[code] != size
        if not differ.any():
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wrong = low[np.repeat(begin, size) + step] != self.text[np.repeat(self.at[code], size) + step]
            if wrong.any():
                differ[np.repeat(np.arange(len(size)), size)[wrong]] = True
        for i in np.flatnonzero(differ):  # two pieces with one hash: the second is kept apart
            self.learn(low, np.zeros(0, np.uint64), begin[i : i + 1], end[i : i + 1])
            code[i] = self.known - 1
        return code

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text."""
        simple = [SIMPLE.fullmatch(t) is not None and "<|" not in t for t in texts]
        counts = np.zeros(len(texts), np.int64)
        out: list[tuple[int, np.ndarray]] = []
        for kind in (True, False):
            rows = [i for i, s in enumerate(simple) if s is kind]
            if not rows:
                continue
            if kind:
                parts = [texts[i].encode() + b" " for i in rows]
                low, begin, end = cut_simple(np.frombuffer(b"".join(parts), np.uint8))
                per_text = np.diff(np.searchsorted(begin, np.r_[0, np.cumsum([len(p) for p in parts])]))
            else:
                pieces = [self.split(texts[i]) for i in rows]
                flat = [p for own in pieces for p in own]
                low = np.frombuffer(b"".join(flat), np.uint8)
                end = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
                begin = np.r_[0, end[:-1]] if len(end) else end
                per_text = np.array([len(p) for p in pieces], np.int64)
            code = self.lookup(low, begin, end) if len(begin) else np.zeros(0, np.int32)
            lengths = self.length[code]
            before = np.r_[0, np.cumsum(lengths)]
            ids = self.pool[np.repeat(self.offset[code] - before[:-1], lengths) + np.arange(before[-1])] if len(code) else np.zeros(0, np.uint32)
            own = np.diff(before[np.r_[0, np.cumsum(per_text)]])
            counts[rows] = own
            if len(rows) == len(texts):
                return ids, counts
            out += zip(rows, np.split(ids, np.cumsum(own)[:-1]), strict=True)
        return (np.concatenate([x for _, x in sorted(out, key=lambda x: x[0])]) if out else np.zeros(0, np.uint32)), counts


class MergeCache(PieceCache):
    """New pieces are merged by the numpy rounds. A special token is a piece of its own, marked by a byte that text doesn't have."""

    MARK = b"\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.to_byte = {c: b for b, c in enumerate(byte_symbols())}
        super().__init__()

    def plain(self, text: str) -> list[bytes]:
        split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.to_byte.__getitem__, p)) for p, _ in split]

    def split(self, text: str) -> list[bytes]:
        special = self.vocabulary.split_special
        out: list[bytes] = []
        at = 0
        if special is not None and "<|" in text:
            for m in special.finditer(text):
                out += [*self.plain(text[at : m.start()]), self.MARK + m[0].encode()]
                at = m.end()
        return out + self.plain(text[at:])

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        special = [(i, self.vocabulary.special[p[1:].decode()]) for i, p in enumerate(pieces) if p[:1] == self.MARK]
        ids, n = merge_words(self.vocabulary, [b"!" if p[:1] == self.MARK else p for p in pieces])
        for i, x in special:
            ids[n[:i].sum()] = x
        return ids, n


_caches: dict[tuple[type, str], PieceCache] = {}


def cache_for(kind: type, path: str) -> PieceCache:
    """This Python worker's cache; workers are used again for many tasks."""
    if (kind, path) not in _caches:
        _caches[kind, path] = kind(path)
    return _caches[kind, path]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encoded(cache: PieceCache, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """start, end, ids and counts for slices of the texts."""
    for a, b in slices(map(len, texts)):
        yield a, b, *cache.encode(texts[a:b])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(MergeCache, path)
        for batch in batches:
            for a, b, ids, counts in encoded(cache, texts_of(batch.column(1))):
                offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The file names no decoder, so tokens are joined by a space as they are."""
    return " ".join(map(vocabulary.tokens.__getitem__, ids.tolist()))


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = cache_for(MergeCache, path).vocabulary
        for batch in batches:
            for a, b in slices(4 * len(x) if x.is_valid else 0 for x in batch.column(1)):
                texts = [decode_ids(vocabulary, np.asarray(x.values)) if x.is_valid else "" for x in batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids as little-endian uint32), decoded_sha256. Encodes and decodes in one pass, so ids needn't be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(MergeCache, path)
        for batch in batches:
            n: list[int] = []
            ids_sha: list[str] = []
            text_sha: list[str] = []
            for _, _, ids, counts in encoded(cache, texts_of(batch.column(1))):
                for own in np.split(ids, np.cumsum(counts)[:-1]):
                    n.append(len(own))
                    ids_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(decode_ids(cache.vocabulary, own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
