"""Toxicity by multiple-instance learning.

A document's label says that it is toxic, not where. Each sentence gets a probability from the
hashed words it has (logistic), a document's score is a noisy-or of its sentences' probabilities,
and the weights are trained on document labels alone by the same rule; the sentence probabilities
then locate the offending sentences. The noisy-or takes every sentence that is likelier toxic than
not, and the worst of the others once: if it took all, the small odds of many harmless sentences
would add up and call long clean texts toxic. Training runs on a bounded sample of the labelled rows
(SAMPLE_WORDS); every text is scored whole. The broadcast weights have a fixed size.

A null or empty text has no sentence and scores 0. Documents with several labels that differ are
left out of the training. Rows are independent, so repeated rows and ties agree. With no toxic or
no other label to learn from, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, slices, sorted_distinct

BUCKETS = 1 << 18
#: A word's first bytes are a second feature.
STEM = 4
#: About so many words of labelled documents are gathered on the driver (4 bytes each) and fitted.
SAMPLE_WORDS = 4_000_000
#: Features in fewer toxic documents of the sample than this have weight 0, and so have those that don't surely raise the odds by this factor (the lower bound, so many standard errors away).
MIN_TOXIC, LIFT, SURE = 3, 2.7, 1.64
STEPS, RATE, DECAY = 150, 0.15, 1e-3
Model = tuple[np.ndarray, float, bool]

_MAP = bytearray(range(256))
for _c in range(128):
    if chr(_c).isupper():
        _MAP[_c] = _c + 32
    elif chr(_c) in ".!?\n":
        _MAP[_c] = 10
    elif not chr(_c).isalnum() and chr(_c) not in "'-":
        _MAP[_c] = 32
_MAP = bytes(_MAP)
_SENTENCE = re.compile(rb"[^\n]*[^\n ][^\n]*")


class _Buckets(dict):
    """Word -> its bucket and that of its first bytes, so that inflected forms share what is learned."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = b = (crc32(word) & (BUCKETS - 1)) << 32 | (crc32(b"^" + word[:STEM]) & (BUCKETS - 1))
        return b

    def of(self, words: list[int]) -> np.ndarray:
        return np.array(words, np.int64).view(np.int32)


def sentences(text: str) -> list[tuple[int, int, list[bytes]]]:
    """Byte span and lower-cased words of each sentence of the text's UTF-8 form. Sentences end at . ! ? and line ends."""
    return [(m.start(), m.end(), m[0].split()) for m in _SENTENCE.finditer(text.encode().translate(_MAP))]


def features(texts: list[str], buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two buckets of each word, buckets of each sentence, sentences of each text."""
    word: list[int] = []
    per_sentence: list[int] = []
    per_text = []
    for text in texts:
        n = 0
        for part in text.encode().translate(_MAP).split(b"\n"):
            if own := part.split():
                word.extend(map(buckets.__getitem__, own))
                per_sentence.append(2 * len(own))
                n += 1
        per_text.append(n)
    return buckets.of(word), np.array(per_sentence, np.int32), np.array(per_text, np.int32)


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of x; counts may be 0."""
    total = np.r_[0, np.cumsum(x)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def counted(z: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Which sentences the noisy-or takes: those with log-odds over 0, and the worst of a text's others."""
    some = per_text[per_text > 0]
    owner = np.repeat(np.arange(len(some)), some)
    take = z > 0
    take[np.lexsort((np.where(take, -np.inf, z), owner))[np.cumsum(some) - 1]] = True
    return take


def document_scores(z: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Noisy-or of the sentences, from their log-odds; texts without sentences score 0."""
    return -np.expm1(-_sums(np.where(counted(z, per_text), np.logaddexp(0, z), 0.0), per_text))


def loss(x: np.ndarray, sentence: np.ndarray, word: np.ndarray, per_text: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the labels of texts with sentences, and its gradient. x: weights and bias; a pair (sentence, word) for each word of a sentence."""
    z = np.bincount(sentence, weights=x[word], minlength=per_text.sum()) + x[-1]
    take = counted(z, per_text)
    total = np.maximum(_sums(np.where(take, np.logaddexp(0, z), 0.0), per_text), 1e-12)
    value = np.where(label == 1, -np.log(-np.expm1(-total)), total).mean()
    d = np.where(label == 1, -1 / np.expm1(total), 1.0) / len(label)
    dz = np.where(take, np.repeat(d, per_text) / (1 + np.exp(-z)), 0.0)
    return float(value), np.r_[np.bincount(word, weights=dz[sentence], minlength=len(x) - 1), dz.sum()]


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x, ascending; x itself is sorted."""
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def train(word: np.ndarray, per_sentence: np.ndarray, per_text: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the sentence bias that make the documents' labels likeliest, by full-batch Adam steps."""
    weights, share = np.zeros(BUCKETS), float(label.mean()) if len(label) else 0.0
    if share in (0.0, 1.0):
        return weights, share
    doc = np.repeat(np.arange(len(per_text)), per_text)
    # A word counts once a sentence, and only if enough documents have it. Large arrays are sorted in place and let go early.
    pair = np.repeat(np.arange(len(per_sentence)), per_sentence)
    pair *= BUCKETS
    pair += word
    pair = _distinct(pair)
    sentence, word = (pair // BUCKETS).astype(np.int32), (pair % BUCKETS).astype(np.int32)
    del pair
    in_doc = doc[sentence]
    in_doc *= BUCKETS
    in_doc += word
    in_doc = _distinct(in_doc)
    seen = np.bincount(in_doc % BUCKETS, minlength=BUCKETS)
    toxic = np.bincount(in_doc[label[in_doc // BUCKETS] == 1] % BUCKETS, minlength=BUCKETS)
    del in_doc
    # From the smoothed log odds of a document with the word, so that a few steps do.
    rate = (toxic + 2 * share) / (seen + 2)
    w = np.clip(np.log(rate / (1 - np.minimum(rate, 0.999))) - np.log(share / (1 - share)), -3, 6)
    # The lower Wilson bound of the rate of toxic documents must raise the odds: rare features need better evidence than frequent ones.
    n, z2 = np.maximum(seen, 1), SURE * SURE
    low = (toxic / n + z2 / (2 * n) - SURE * np.sqrt(toxic / n * (1 - toxic / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    use = np.flatnonzero((toxic >= MIN_TOXIC) & (low / (1 - np.minimum(low, 0.999)) >= LIFT * share / (1 - share)))
    index = np.full(BUCKETS, -1)
    index[use] = np.arange(len(use))
    kept = index[word] >= 0
    # Sentences without a feature all have the bias as their log-odds: one a text is enough, after the others.
    has, sentence = np.unique(sentence[kept], return_inverse=True)
    word, n = index[word[kept]], len(label)
    own = np.bincount(doc[has], minlength=n)
    blank = own < per_text
    sentence = (np.arange(len(has)) + (np.cumsum(blank) - blank)[doc[has]])[sentence]
    x = np.r_[w[use], np.log(share / (1 - share))]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        _, g = loss(x, sentence, word, own + blank, label)
        g[:-1] += DECAY * x[:-1] / max(1, len(use)) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[use] = x[:-1]
    return weights, float(x[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_words: int) -> DataFrame:
    """Labelled rows in a share, by a hash of the id, that makes about max_words words."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).filter("label = other").select("label_id", "label")
    size = docs.select(F.col(id_col).cast("long").alias("label_id"), F.length(text_col).alias("n")).filter("n > 0")
    total = (size.join(known, "label_id").agg(F.sum("n")).first()[0] or 0) / 6
    share = min(1.0, max_words / max(1.0, total))
    picked = known.filter(F.pmod(F.xxhash64("label_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    return texts.join(picked, "label_id").select("label_id", F.col("label").cast("int").alias("label"), "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_words: int = SAMPLE_WORDS) -> Model:
    """Weights, bias, and whether anything could be learned (else bias is the share of toxic labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(map(len, texts)):
                each = [features([text], buckets) for text in texts[a:b]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2)), *(pa.array([e[i].tobytes() for e in each], pa.binary()) for i in range(2))], ["label_id", "label", "word", "per_sentence"])

    rows = labelled_sample(docs, labels, id_col, text_col, label_col, max_words).mapInArrow(run, "label_id long, label int, word binary, per_sentence binary").toArrow().sort_by("label_id")
    each = [[np.frombuffer(x.as_buffer(), np.int32) for x in rows[c].combine_chunks()] for c in ("word", "per_sentence")] if rows.num_rows else [[], []]
    label = np.array(rows["label"].to_pylist() or [], float)
    word, per_sentence = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in each)
    weights, bias = train(word, per_sentence, np.array([len(x) for x in each[1]], np.int64), label)
    return weights, bias, 0 < (label.mean() if len(label) else 0) < 1


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, n_sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = [[np.zeros(0)], [np.zeros(0, np.int64)]]
            for a, b in slices(map(len, texts)):
                p, n = scored(texts[a:b], shared.value, buckets)
                out[0].append(p)
                out[1].append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]))], ["doc_id", "score", "n_sentences"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, n_sentences long")


def keep(docs: DataFrame, model: Model, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under `below`, all columns as they were. Rows stay where they are: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in slices(map(len, texts)):
                p, _ = scored(texts[a:b], shared.value, buckets)
                yield batch.slice(a, b - a).filter(pa.array(p < below))

    return docs.mapInArrow(run, docs.schema)


def sentence_odds(word: np.ndarray, per_sentence: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each sentence; a word counts once."""
    if not len(word):
        return np.zeros(0)
    hot = np.flatnonzero(weights[word] != 0)
    pair = sorted_distinct(np.repeat(np.arange(len(per_sentence)), per_sentence)[hot].astype(np.int64) * BUCKETS + word[hot])
    return np.bincount(pair // BUCKETS, weights=weights[pair % BUCKETS], minlength=len(per_sentence)) + bias


def scored(texts: list[str], model: Model, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Scores of whole texts, and how many sentences they have."""
    weights, bias, learned = model
    word, per_sentence, per_text = features(texts, buckets)
    if not learned:
        return np.where(per_text > 0, bias, 0.0), per_text.astype(np.int64)
    return np.clip(document_scores(sentence_odds(word, per_sentence, weights, bias), per_text), 0, 1), per_text.astype(np.int64)


def locate(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per offending sentence: doc_id, start and end (code points of the text), sentence, score of the sentence (at least `least`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, learned = shared.value
        buckets = _Buckets()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = [s for s in sentences(text or "") if s[2]] if learned else []
                if not spans:
                    continue
                word = buckets.of([buckets[w] for s in spans for w in s[2]])
                p = 1 / (1 + np.exp(-sentence_odds(word, np.array([2 * len(s[2]) for s in spans]), weights, bias)))
                raw = text.encode()
                for i in np.flatnonzero(p >= least):
                    a, b = (len(raw[:k].decode()) for k in spans[i][:2])
                    for col, x in zip(rows, (doc_id, a, b, text[a:b], float(p[i])), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["doc_id", "start", "end", "sentence", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(id_crc(id_col) % 5 == 0, F.lit(True))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences; learned from the labels of rows that aren't held out."""
    model = fit(docs.filter(~held_out()), labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences")
