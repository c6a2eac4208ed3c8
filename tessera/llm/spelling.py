"""Spelling variants by anagram hashing.

Words are counted over all texts. A word's anagram key is the sum of the fifth powers of its letters
(modulo 2^64), so that all orders of the same letters have one key, and adding, removing or
exchanging a letter adds a known value. Two words that differ by one removed letter meet where the
key of the one is the other's without that letter's value; two that differ by an exchange meet where
their keys are the same without the values of the letters exchanged. So each word is sent to its own
key and to the key without each of its letters, and the join on these keys finds every difference of
one letter of the alphabet. Letter order is verified by what is left of the word: equal rests with
the letter gone from the same place are an exchange, a rest that is a word itself is a removal.

The rest is part of the shuffle's key, so anagrams, however many, are spread; a group holds at most
one word a letter of the alphabet and place, and no pairs are made: each member gets the group's size
less one and its largest other member. A near word is met in one group exactly, as removals from a
run of one letter are made once.

Cases: a null text has no words; a null doc_id is written as the empty text. Words of over LONG
letters compare rests by a 124-bit hash, as whole ones would grow with the square of the length.
Repeated rows count again. Ties of n go to the smaller word in code-point order. An empty table gives
no words. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

LEAST_LETTERS, LEAST_COUNT, TIMES, NOISE = 6, 5, 5, 199
#: Letters up to which a rest is compared as text.
LONG = 64
#: Primes and bases of the hash of longer rests.
_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
_BASES = np.array([1000003, 998244353, 1597334677, 776531401], np.uint64)
_MASK = (1 << 64) - 1
#: Rows of an output batch.
_ROWS = 1 << 15
_SCHEMA = pa.schema([("key", pa.int64()), ("rest", pa.string()), ("place", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def _words(doc_id: Column, text: Column) -> Column:
    """Array of the runs of at least LEAST_LETTERS letters; a shorter one can't be a word, as runs only lose letters."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"[a-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}}"), F.lit(0))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences. One letter goes from each run whose crc32 (of `<id>:<run>`) NOISE divides."""
    doc_id = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    runs = docs.select(doc_id.alias("doc"), F.explode(_words(doc_id, text)).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def numbered(words: DataFrame) -> DataFrame:
    """words (word, n), computed once, with id, the place in code-point order."""
    in_order = checkpointed(words.sort("word"))
    kept = checkpointed(in_order.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "word", "n"))
    counts = dict(kept.groupBy("part").count().collect())
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    # One row a partition.
    begin = words.sparkSession.createDataFrame(list(starts.items()) or [(-1, 0)], "part int, begin long")
    return kept.join(F.broadcast(begin), "part").select((F.col("begin") + F.col("row")).alias("id"), "word", "n")


def _rest_hashes(codes: np.ndarray) -> tuple[list[str], str]:
    """Of a word's code points: the hash of what is left without each letter, and of the whole."""
    size = len(codes)
    sums = []
    for p, b in zip(_PRIMES, _BASES):
        power = np.ones(size + 1, np.uint64)
        done, step = 1, b
        while done <= size:  # powers by doubling
            more = min(done, size + 1 - done)
            power[done : done + more] = power[:more] * step % p
            step, done = step * step % p, done + more
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * power[:size] % p)]
        inverse = np.uint64(pow(int(b), -1, int(p)))
        rests = (total[:-1] + (total[-1] - total[1:]) % p * inverse) % p
        sums.append((rests, int(total[-1] % p)))
    rests = [f"{size - 1}#" + "-".join(f"{x:x}" for x in row) for row in zip(*(r.tolist() for r, _ in sums))]
    return rests, f"{size}#" + "-".join(f"{x:x}" for _, x in sums)


def _signed(key: int) -> int:
    return (key & _MASK) - ((key & (1 << 63)) << 1)


def probes(word: str) -> Iterator[tuple[int, str, int]]:
    """(key, rest, place): the word itself (place -1), and it without each letter (twice the place, plus one where the letter doesn't repeat the one before)."""
    codes = [ord(c) for c in word]
    powers = [c**5 for c in codes]
    key, size = sum(powers), len(codes)
    hashes, whole = _rest_hashes(np.array(codes)) if size > LONG else (None, word)
    yield _signed(key), whole, -1
    for i in range(size):
        rest = word[:i] + word[i + 1 :] if size - 1 <= LONG else hashes[i]
        yield _signed(key - powers[i]), rest, 2 * i + (i == 0 or codes[i] != codes[i - 1])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
        rows.clear()
        return out

    for batch in batches:
        for id_, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for probe in probes(word):
                rows.append((*probe, id_, n))
                if len(rows) >= _ROWS:
                    yield flush()
    if rows:
        yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """words: id, word, n -> id, n_near, and best (less: minus n, id): the near word of largest n, then smallest id. Words without a near one have no row."""
    met = words.select("id", "word", "n").mapInArrow(_probe, "key long, rest string, place long, id long, n long").repartition("key", "rest")
    word = F.struct((-F.col("n")).alias("less"), "id")
    same = met.filter("place >= 0").groupBy("key", "rest", F.shiftright("place", 1).alias("at")).agg(F.sort_array(F.collect_list(word)).alias("of")).filter(F.size("of") > 1)
    exchanged = same.select(F.size("of").alias("size"), F.col("of")[0].alias("a"), F.col("of")[1].alias("b"), F.explode("of").alias("w"))
    exchanged = exchanged.select(F.col("w.id").alias("id"), (F.col("size") - 1).cast("long").alias("near"), F.when(F.col("w") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("best"))
    whole = F.col("place") < 0
    pairs = met.filter("place < 0 or place % 2 = 1").groupBy("key", "rest").agg(F.max(F.when(whole, word)).alias("short"), F.sort_array(F.collect_list(F.when(~whole, word))).alias("long"))
    pairs = pairs.filter(F.col("short").isNotNull() & (F.size("long") > 0))
    shorter = pairs.select(F.col("short.id").alias("id"), F.size("long").cast("long").alias("near"), F.col("long")[0].alias("best"))
    longer = pairs.select(F.explode("long").alias("w"), "short").select(F.col("w.id").alias("id"), F.lit(1).cast("long").alias("near"), F.col("short").alias("best"))
    return exchanged.unionByName(shorter).unionByName(longer).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: id, form -> id, root: where the forms lead. Each round doubles the steps; n grows TIMES-fold a step, so few rounds do."""
    to = checkpointed(forms.select("id", F.col("form").alias("root")))
    while True:
        on = to.select(F.col("id").alias("root"), F.col("root").alias("further"))
        to = checkpointed(to.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not to.filter("moved").head(1):
            return to.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of count_words(). form: the near word of largest n, if that is TIMES the word's own at least; root: the last of the forms."""
    words = checkpointed(numbered(count_words(docs, id_col, text_col)))
    near = words.join(near_words(words), "id", "left")
    formed = F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best.id"))
    near = checkpointed(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), formed.alias("form")))
    lead = roots(near.filter("form is not null").select("id", "form"))
    name = lambda at, text, n: words.select(F.col("id").alias(at), F.col("word").alias(text), F.col("n").alias(n))
    out = near.join(lead, "id", "left").withColumn("root", F.coalesce("root", "id"))
    out = out.withColumnRenamed("form", "form_id").withColumnRenamed("root", "root_id")
    out = out.join(name("form_id", "form", "form_n"), "form_id", "left").join(name("root_id", "root", "root_n"), "root_id")
    return out.select("word", "form", "root", "n", "n_near", "form_n")
