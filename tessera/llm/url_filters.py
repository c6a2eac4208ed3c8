"""URL filters by a sort-merge range join.

A url's key is its host's labels from the last to the first, each with a dot behind it, and then its
path: `https://www.example.com/en/1` has `com.example.www./en/1`. All urls of a host and its
subdomains then stand together, in the interval of keys that begin with the host's part, and the
intervals of rules nest. Splitters from a sample of keys deal the urls to partitions by key; a rule
goes to each partition that its interval meets. Every partition is sorted by key and swept once: a
stack holds the hosts whose interval is open, innermost last, with the paths of their rules, and each
url asks the hosts on the stack for the longest rule whose path it starts with.

A rule (host, path, verdict) fits its host and all subdomains, if the url's path starts with the
rule's. The rule of most characters (host and path) wins, of two that differ in the verdict alone
`block`. A url that no rule fits gets the verdict `default`.

Scale: one shuffle of the urls, none of other columns but those carried. A url that a third of all
rows share is a splitter several times, and its rows are dealt over the partitions between. A task holds
a batch, and the rules of one host and of the hosts above it. Rules aren't broadcast.

Cases: a null url, or one without `://`, has an empty host and path, which no rule with a named host
fits. A url without a path has the empty path, which a rule `com/` doesn't fit. Rules with a null
host or path are none; a null verdict counts as `block`. Repeated rows are each judged. Empty tables give an empty result, or
the default alone. Columns of pages named host, path, rule or verdict give way to the result's.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

#: Bytes of keys of a partition, sampled keys a partition, and bytes of keys that the driver samples.
PARTITION_BYTES, SAMPLES, SAMPLE_BYTES = 32 << 20, 24, 32 << 20
RESULT = ("host", "path", "rule", "verdict")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, after the first :// up to / ? # or the end, and the path from there up to ? # or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def splitters(sample: list[bytes], partitions: int) -> list[bytes]:
    """Up to partitions - 1 keys at even counts of the sample, ascending; each as short as tells it from the sampled key before, whole and repeated where a key fills more than a partition."""
    keys = sorted(sample)
    out = []
    for at in (len(keys) * i // partitions for i in range(1, partitions)):
        if at:
            before, key = keys[at - 1], keys[at]
            n = next((i for i, (a, b) in enumerate(zip(before, key)) if a != b), min(len(before), len(key)))
            out.append(key if before == key else key[: n + 1])
    return out


def _sample(keyed: DataFrame, key: str) -> tuple[list[bytes], int]:
    spark = keyed.sparkSession
    n, total = keyed.agg(F.count("*"), F.sum(F.octet_length(key))).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // PARTITION_BYTES))
    want = min(SAMPLES * partitions, SAMPLE_BYTES // max(1, (total or 0) // max(1, n)))
    share = min(1.0, want / max(1, n))
    picked = keyed.filter(F.rand(7) < share) if share < 1 else keyed
    return [bytes(r[0]) for r in picked.select(key).collect()], partitions


def _deal(frame: DataFrame, key: str, part: str, shared, interval: bool) -> DataFrame:
    """frame with the partition of each row: for a url one that its key may be in, for a rule each that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = shared.value
        for batch in batches:
            rows, parts = [], []
            for i, k in enumerate(batch.column(batch.schema.names.index(key)).to_pylist()):
                low, high = bisect_left(splits, k), bisect_right(splits, k + b"\xff" if interval else k)
                if interval:
                    rows += [i] * (high - low + 1)
                    parts += range(low, high + 1)
                else:
                    rows.append(i)
                    parts.append(low + i % (high - low + 1))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(c.take(pa.array(rows, pa.int64())) for c in batch.columns)], [part, *batch.schema.names])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"`{part}` int{kinds}")


class Stack:
    """The hosts whose interval is open, innermost last, with their rules."""

    def __init__(self):
        self.open: list[tuple[bytes, dict[str, tuple[str, str]], list[int]]] = []

    def to(self, key: bytes) -> None:
        """Close what key isn't in."""
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def rule(self, key: bytes, path: str, rule: str, verdict: str) -> None:
        self.to(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, rules, sizes = self.open[-1]
        if path not in rules or verdict == "block":
            rules[path] = (rule, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def longest(self, key: bytes, path: str) -> tuple[str, str] | None:
        self.to(key)
        best = None
        for _, rules, sizes in reversed(self.open):
            for n in sizes:
                found = rules.get(path[:n]) if n <= len(path) else None
                if found:
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of pages with host, path, rule (host and path of the rule that holds, or null) and verdict. rules: host, path, verdict."""
    own = [c for c in pages.columns if c.lower() not in RESULT]
    key, kind, part, rule_path = (fresh_name(pages, x) for x in ("key", "kind", "part", "rule_path"))
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    urls = urls.withColumn(key, F.concat(host_key(F.col("host")), "path").cast("binary"))
    sample, partitions = _sample(urls, key)
    shared = pages.sparkSession.sparkContext.broadcast(splitters(sample, partitions))
    named = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
    named = named.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path"), F.coalesce("verdict", F.lit("block")).alias("verdict"))
    named = named.select(F.concat("host", "path").alias("rule"), F.col("path").alias(rule_path), "verdict", host_key(F.col("host")).cast("binary").alias(key))
    swept = _deal(urls, key, part, shared, False).withColumn(kind, F.lit(1)).unionByName(_deal(named, key, part, shared, True).withColumn(kind, F.lit(0)), allowMissingColumns=True)
    swept = swept.repartitionById(partitions, F.col(part)).sortWithinPartitions(key, kind).drop(part)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack()
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            column = lambda c: batch.column(at[c])
            keys, paths, urls_ = column(key).to_pylist(), column("path").to_pylist(), column(kind).to_numpy(zero_copy_only=False) == 1
            texts, verdicts = [], []
            for i, k in enumerate(keys):
                if urls_[i]:
                    found = stack.longest(k, paths[i])
                    texts.append(found[0] if found else None)
                    verdicts.append(found[1] if found else default)
                else:
                    stack.rule(k, column(rule_path)[i].as_py(), column("rule")[i].as_py(), column("verdict")[i].as_py())
            rows = pa.array(np.flatnonzero(urls_))
            yield pa.RecordBatch.from_arrays([*(column(c).take(rows) for c in (*own, "host", "path")), pa.array(texts, pa.string()), pa.array(verdicts, pa.string())], [*own, *RESULT])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name in own)
    return swept.mapInArrow(sweep, f"{kinds}host string, path string, rule string, verdict string")
