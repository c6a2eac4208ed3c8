"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every text with a label, hashed to a fixed number of buckets, per
language: sums per task, then one aggregation of (language, bucket, count). The matrix of log
probabilities has languages x buckets cells, whatever the corpus' size, and is broadcast; texts
are scored batch by batch in numpy from the sparse counts of their buckets.

The language is that of the largest posterior, ties to the one that sorts first; und if the text
is null or has no letter, or if nothing was learned. Rows are independent, so repeated rows agree.
An empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: More labels than this are an error (the broadcast matrix would have no bound), not cut off.
MOST_LANGUAGES = 512
UNKNOWN = "und"


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the text of each. Case is folded; runs of other characters than letters are one space, also at the ends."""
    chars = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    code = np.concatenate(chars) if chars else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in chars])
    low = code < 128
    letter = ~low | ((code >= 97) & (code <= 122))
    code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    keep = letter | np.r_[True, letter[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
    code, owner = code[keep], owner[keep]
    buckets, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in GRAMS:
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            same = owner[: len(h)] == owner[n - 1 :]
            buckets.append((mixed >> np.uint64(64 - 15)).astype(np.int64)[same])
            owners.append(owner[: len(h)][same])
    return np.concatenate(buckets), np.concatenate(owners)


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a language, and (lang, -1, number of documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(map(len, texts), 1 << 19):
                names = sorted(set(langs[a:b]))
                row = np.array([names.index(x) for x in langs[a:b]])
                bucket, owner = gram_buckets(texts[a:b])
                counts = np.bincount(row[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for i, name in enumerate(names):
                    own = totals.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    own[:BUCKETS] += counts[i]
                    own[BUCKETS] += int((row == i).sum())
        for name, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and their log probabilities: one row each of BUCKETS columns and a last one for the prior."""
    counts = gram_counts(docs, text_col, lang_col).cache()
    try:
        langs = sorted(r[0] for r in counts.filter("bucket = -1").select("lang").limit(MOST_LANGUAGES + 1).collect())
        if len(langs) > MOST_LANGUAGES:
            raise ValueError(f"over {MOST_LANGUAGES} languages")
        cells = counts.toPandas()
    finally:
        counts.unpersist()
    n = np.zeros((len(langs), BUCKETS + 1))
    n[np.searchsorted(langs, cells["lang"].to_numpy(dtype=str)) if len(cells) else [], cells["bucket"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy()
    grams = n[:, :BUCKETS] + SMOOTHING
    prior = n[:, BUCKETS:]
    return langs, np.log(np.c_[grams / grams.sum(1, keepdims=True), prior / max(prior.sum(), 1)]).astype(np.float64)


def score_texts(texts: list[str | None], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text; table as fit() gives it, one column a language."""
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not langs or not real:
        return out, score
    bucket, owner = gram_buckets([texts[i] for i in real])
    # Sparse rows: each text's buckets once, with their counts.
    cell = np.sort(owner * BUCKETS + bucket)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cell, n = cell[first], np.diff(np.r_[first, len(cell)])
    row = cell // BUCKETS
    starts = np.searchsorted(row, np.arange(len(real)))
    like = np.add.reduceat(table[cell % BUCKETS] * n[:, None], starts, axis=0) + table[BUCKETS]
    like -= like.max(1, keepdims=True)
    best = like.argmax(1)
    posterior = 1 / np.exp(like).sum(1)
    for i, k, p in zip(real, best.tolist(), posterior.tolist(), strict=True):
        out[i], score[i] = langs[k], p
    return out, score


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns in keep (or doc_id), then lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, np.ascontiguousarray(table.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cells = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang: list[str] = []
            score: list[np.ndarray] = [np.zeros(0)]
            for a, b in slices((len(t or "") for t in texts), 1 << 19):
                own, p = score_texts(texts[a:b], names, cells)
                lang += own
                score.append(p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(np.concatenate(score))], [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), F.col(text_col).cast("string").alias("text"))
    kept = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")
