"""Operators against brute force on a small corpus with nulls, empty and long texts, copies, ties and clashing columns."""

import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tessera.llm import bpe, components, exact_dedup, langid, license_scan, mih, mixing, queries, simhash, substrings, token_store, toxicity
from tessera.llm.common import slices

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_slices_cover_all_rows():
    assert list(slices([5, 5, 100, 1], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(slices([], 10)) == []


# Exact dedup


def exact_brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        norm = (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id))
    out = {}
    for norm, own in groups.items():
        keep = min(own)[1]
        out |= {d: (keep, len(own), d == keep, hashlib.sha256(norm).hexdigest()) for _, d in own}
    return out


@pytest.mark.parametrize("size", [1 << 30, 20_000, 2_000])
def test_exact_groups(docs, rows, size, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PARTITION_BYTES", size)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == exact_brute(rows)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, _, k, _) in got.items() if k)


def test_exact_copies_over_many_partitions(spark, monkeypatch):
    # One text in most rows: its run goes on over partition ends, and is one group all the same.
    monkeypatch.setattr(exact_dedup, "PARTITION_BYTES", 2_000)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(df).filter("group_size > 1").agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.count_if("kept")).first()
    assert tuple(got) == (1600, 1600, 0, 1)
    in_order, found = exact_dedup._sorted(df)
    assert sum(s[0] == b"sametext" for s in found) > 10
    sizes = [r["count"] for r in in_order.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()) == sorted({i for i in range(2000) if i % 10 > 7} | {0})


def test_splitters_are_short():
    keys = [(b"a" * 50 + bytes([c]), -1, i) for i, c in enumerate(b"bdfh")] + [(b"zz" * 9, -18, 7), (b"zz" * 9, -18, None)]
    found = exact_dedup.splitters(keys, 100)
    assert found == sorted(found) and len(found) == 5
    assert [f[0] for f in found[:4]] == [b"a" * 50 + b"d", b"a" * 50 + b"f", b"a" * 50 + b"h", b"z"]
    assert found[4] == (b"zz" * 9, -18, 7)
    assert exact_dedup.splitters([], 9) == []


def test_exact_drop_keeps_columns_and_one_of_repeated_rows(docs, none, rows):
    kept = exact_dedup.drop_exact_copies(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, _, k, _) in exact_brute(rows).items() if k)
    assert exact_dedup.drop_exact_copies(none).count() == 0 == exact_dedup.exact_groups(none).count()
    nulls = docs.filter("doc_id < 8").withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert exact_dedup.drop_exact_copies(nulls).count() == 5 == exact_dedup.exact_groups(nulls).filter("kept").count()


# Mixing


def sql_rows(sql, rows):
    import pandas as pd

    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"text": object, "source": object}))
    con.sql("create view documents as select doc_id, nullif(text, 'NaN') as text, lang, source from frame")
    return con.sql(sql)


def test_mix_is_what_sql_says(docs, rows, none):
    want = sorted(sql_rows(queries.OP6_SQL, rows).fetchall())
    got = sorted(tuple(r) for r in mixing.mix_report(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want
    assert mixing.mix_report(none).count() == 0 == mixing.mix(none).count()


def test_mix_targets_by_rounds(spark):
    sizes = [("a", 100), ("b", 100), ("c", 300), ("d", 10), (None, 50), ("z", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size, left, target = dict(sizes), 1.5 * sum(n for _, n in sizes), {}
    while True:
        free = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in target.items()}


def test_mix_repeats_rows(docs):
    want = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect() if r.copies}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    assert max(want.values()) <= 2


# BPE


def test_bpe_is_the_library(docs, rows, none, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(docs, PATH).collect()}
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text_out = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text_out.encode()).hexdigest()), text
    assert bpe.round_trip(none, PATH).count() == 0


def test_bpe_encode_and_decode(docs, rows, library):
    encoded = bpe.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {d: library.encode(t or "", add_special_tokens=False).ids for d, t, *_ in rows}
    want = {d: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for d, t, *_ in rows}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()} == want


def test_bpe_odd_characters(library):
    cache = bpe.MergeCache(PATH)
    parts = [*"ab'\x1c\x85\xa0 ​!,9é×÷ßẞŒİΣσ", "'s", "'ll", "'re", "''", "́", "<|endoftext|>", "aaaa", "\n"]
    texts = ["".join(p) for p in itertools.product(parts, repeat=3)] + ["a" * 5000, "!" * 999, "'" * 7 + "s"]
    ids, counts = cache.encode(texts)
    for own, e in zip(np.split(ids, np.cumsum(counts)[:-1]), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.tolist() == e.ids


def test_bpe_cache_forgets(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    cache = bpe.MergeCache(PATH)
    for k in range(5):
        texts = [f"word{k}{i} and {chr(97 + i % 26)}x" for i in range(40)]
        ids, counts = cache.encode(texts)
        assert ids.tolist() == [x for e in library.encode_batch(texts, add_special_tokens=False) for x in e.ids]


# Token store


def test_store_round_trip(spark, docs, rows, library, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, folder, PATH)
    want, start = {}, 0
    for d, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[d] = (start, ids)
        start += len(ids)
    assert {r.doc_id: (r.start, r.ids) for r in token_store.read_documents(spark, folder).collect()} == want
    sums = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_sums(spark, folder).collect()}
    assert sums == {d: (s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, (s, ids) in want.items()}
    packs = spark.read.parquet(f"{folder}/packs")
    assert packs.count() == packs.select("digest").distinct().count()
    # Copies share their chunks.
    total = spark.read.parquet(f"{folder}/recipes").selectExpr("sum(size(chunks))").first()[0]
    assert packs.count() < total


def test_store_finds_damage(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, folder, PATH)
    broken = spark.read.parquet(f"{folder}/packs").withColumn("payload", F.when(F.col("n") > 1, F.concat(F.col("payload"), F.unhex(F.lit("0000")))).otherwise(F.col("payload")))
    broken.write.parquet(f"{folder}/packs2")
    (tmp_path / "store/packs").rename(tmp_path / "store/packs1")
    (tmp_path / "store/packs2").rename(tmp_path / "store/packs")
    with pytest.raises(Exception, match="differs from its digest"):
        token_store.read_sums(spark, folder).collect()


@pytest.mark.parametrize("name", ["recipes", "manifest", "parts"])
def test_store_finds_lost_rows(spark, docs, tmp_path, name):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, folder, PATH, block_docs=2)
    assert spark.read.parquet(f"{folder}/manifest").count() >= docs.count() / 2
    table = spark.read.parquet(f"{folder}/{name}")
    table.limit(table.count() - 1).write.parquet(f"{folder}/cut")
    (tmp_path / f"store/{name}").rename(tmp_path / "store/old")
    (tmp_path / "store/cut").rename(tmp_path / f"store/{name}")
    with pytest.raises(Exception, match="differ from the manifest"):
        token_store.read_sums(spark, folder).collect()


def test_store_of_repeated_rows_and_wide_ids(spark, docs, rows, library, tmp_path, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)  # the end id alone is a hot chunk
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs.union(docs), folder, PATH, width="<u4")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_sums(spark, folder, "<u4").collect())
    want, start = [], 0
    for d, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for _ in range(2):
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert got == want


def test_store_of_nothing(spark, none, tmp_path):
    token_store.write_store(none, f"file://{tmp_path}/store", PATH)
    assert token_store.read_sums(spark, f"file://{tmp_path}/store").count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 49000, 9000).astype(np.uint32), rng.integers(0, 49000, 500).astype(np.uint32)
    cuts = lambda x: token_store.cut_points(x, np.array([len(x)]))
    chunks = lambda x: {x[s:e].tobytes() for s, e in zip([0, *cuts(x)[:-1]], cuts(x), strict=True)}
    assert len(chunks(a) & chunks(np.r_[b, a])) >= len(chunks(a)) - 2
    assert max(np.diff(cuts(np.zeros(50_000, np.uint32)))) <= token_store.LONGEST
    # Documents that lie together are cut as each alone.
    both = token_store.cut_points(np.r_[a, b, a], np.array([9000, 500, 9000]))
    assert both.tolist() == [*cuts(a), *(9000 + cuts(b)), *(9500 + cuts(a))]


def test_crc_of_parts():
    parts = [[b"abcd" * 5, b"x" * 4], [b"1234"], [b"q" * 400, b"", b"zz"]]
    flat = [p for own in parts for p in own]
    got = token_store.crc_of_parts(np.array([zlib.crc32(p) for p in flat]), np.array([len(p) for p in flat]), np.array([len(p) for p in parts]))
    assert got.tolist() == [zlib.crc32(b"".join(p)) for p in parts]


# Language


def test_language(spark, docs, rows, none):
    langs, cells = langid.fit(docs)
    assert langs == ["en", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs, langs, cells).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d, t, *_ in rows if not t or not any(map(str.isalpha, t)))
    assert all(0 <= r.score <= 1 for r in got.values())
    plain = [d for d, *_ in rows if 6 <= d < 36]
    assert sum(got[d].lang_pred == rows[d][2] for d in plain) >= 0.9 * len(plain)
    assert langid.fit(none)[0] == [] and {r.lang_pred for r in langid.predict(docs, *langid.fit(none)).collect()} == {"und"}
    assert langid.predict(none, langs, cells).count() == 0


def test_language_counts_by_hand(spark):
    df = spark.createDataFrame([("ab", "x"), ("ab", "x"), ("c1", "y"), (None, "y"), ("q", None)], "text string, lang string")
    n = {(r.lang, r.bucket): r.n for r in langid.gram_counts(df).collect()}
    assert n[("x", -1)] == 2 and n[("y", -1)] == 1
    # " ab " has 4 + 3 + 2 grams; in "c1" the digit is a space like the ends: " c ".
    assert sum(v for (lang, b), v in n.items() if lang == "x" and b >= 0) == 18
    assert sum(v for (lang, b), v in n.items() if lang == "y" and b >= 0) == 6


# Toxicity


def toxic_docs():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        lines = [" ".join(rng.choice(vocabulary, 8)) for _ in range(int(rng.integers(1, 12)))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            k = int(rng.integers(len(lines)))
            lines[k] = f"you are {rng.choice(['scum', 'trashy', 'trashes'])} {lines[k]}"
        rows.append((i, ". ".join(lines)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_docs()
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    label = spark.createDataFrame([*labels, (1000, 1), (5, 1 - labels[5][1]), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.predict(docs, label).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 600]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values())
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.95
    assert out[1000].score == out[1001].score == 0
    model = toxicity.fit(docs.filter(~toxicity.held_out()), label)
    found = toxicity.locate(docs, model).collect()
    text = dict(rows)
    assert found and all(text[r.doc_id][r.start : r.end] == r.sentence for r in found)
    assert np.mean(["scum" in r.sentence or "trash" in r.sentence for r in found]) > 0.95
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in out.items() if not r.predicted)


def test_toxicity_without_labels(spark, docs, none):
    no = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.predict(docs, no).collect()} == {0.0}
    assert toxicity.predict(none, no).count() == 0
    clean = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.predict(docs, clean).collect()} == {0}


def test_toxicity_of_long_clean_texts(spark):
    # Sentences of clean documents that weren't learned from, in each language: no length makes them toxic, and one bad sentence still does.
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.filter(~toxicity.held_out()), labels)
    held = docs.filter(toxicity.held_out()).join(labels, "doc_id").select("lang", "text", "toxic").collect()
    score = lambda texts: toxicity.scored(texts, model, toxicity._Buckets())[0]
    p = score([r.text for r in held])
    bad = [r.text for r, x in zip(held, p, strict=True) if r.toxic and x >= 0.5]
    assert np.mean((p >= 0.5) == np.array([r.toxic for r in held])) > 0.97 and len({r.lang for r in held}) == 4
    for lang in sorted({r.lang for r in held}):
        clean = [r.text.encode()[a:b].decode() for r in held if r.lang == lang and not r.toxic for a, b, own in toxicity.sentences(r.text) if own]
        texts = [". ".join(clean[i % len(clean)] for i in range(n)) for n in (1000, 5000, 20000)]
        assert (score(texts) < 0.5).all()
        assert (score([f"{t}. {bad[0]}" for t in texts]) >= 0.5).all()
    assert (score(["", "zzz. zzz", "zzz. " * 20000]) == [0, *[score(["zzz"])[0]] * 2]).all()


def test_noisy_or():
    z = np.array([0.3, -1.0, 2.0, -1.0, -2.0, 0.5])
    p = 1 / (1 + np.exp(-z))
    got = toxicity.document_scores(z, np.array([2, 0, 1, 2, 1]))
    assert np.allclose(got, [1 - (1 - p[0]) * (1 - p[1]), 0, p[2], p[3], p[5]])
    assert toxicity.document_scores(np.zeros(0), np.zeros(3, int)).tolist() == [0, 0, 0]


def test_toxicity_loss_against_a_plain_loop():
    rng = np.random.default_rng(5)
    per_text = np.array([3, 1, 4, 2, 5])
    owner = np.repeat(np.arange(5), per_text)
    pairs = sorted({(int(rng.integers(15)), int(rng.integers(6))) for _ in range(40)})
    sentence, word = (np.array(x) for x in zip(*pairs, strict=True))
    label = np.array([1, 0, 1, 0, 1.0])
    x = np.r_[rng.normal(0, 1, 6), -0.4]

    def plain(x):
        out = 0
        for d in range(5):
            z = [sum(x[w] for t, w in pairs if t == s) + x[-1] for s in range(15) if owner[s] == d]
            rest = [v for v in z if v <= 0]
            clean = math.prod(1 / (1 + math.exp(v)) for v in [*(v for v in z if v > 0), *([max(rest)] if rest else [])])
            out -= math.log(1 - clean if label[d] else clean)
        return out / 5

    value, gradient = toxicity.loss(x, sentence, word, per_text, label)
    assert abs(value - plain(x)) < 1e-9
    for i in range(len(x)):
        step = np.eye(len(x))[i] * 1e-6
        assert abs(gradient[i] - (plain(x + step) - plain(x - step)) / 2e-6) < 1e-5


def test_toxicity_of_clashing_long_and_repeated_rows(spark, docs):
    rows, labels = toxic_docs()
    label = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("label", F.lit("x")).withColumn("text", F.lit("scum"))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("toxic", F.lit(1)), label)
    mixed = docs.union(docs).unionByName(docs.limit(1).withColumn("text", F.lit("you are scum w1. " + "w1 w2 w3. " * 30_000)).withColumn("doc_id", F.lit(9000)))
    out = toxicity.score(mixed, model).collect()
    assert len(out) == 2 * docs.count() + 1 and all(0 <= r.score <= 1 for r in out)
    assert len({(r.doc_id, r.score) for r in out}) == docs.count() + 1
    assert next(r.score for r in out if r.doc_id == 9000) >= 0.5
    kept = toxicity.keep(mixed, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9000").count() == 0 and kept.count() % 2 == 0


# SimHash


def fingerprint_brute(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_brute(fps):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("part", [4096, 2])
def test_near_groups(docs, rows, part):
    fps = [fingerprint_brute(t) for _, t, *_ in rows]
    want = {i: (format(f, "016x"), c) for i, (f, c) in enumerate(zip(fps, component_brute(fps), strict=True))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs, part=part).collect()} == want


@pytest.mark.parametrize("layout", [layout for _, layout in simhash.LAYOUTS])
def test_links_of_planted_fingerprints(spark, layout):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for x in fps[:40]:
        near = x
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            near ^= 1 << int(b)
        fps.append(near)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), layouts=((0, layout),)).collect()
    place = {s: i for i, s in enumerate(signed)}
    up = component_brute(fps)
    assert all((fps[place[r.a]] ^ fps[place[r.b]]).bit_count() <= 4 for r in links)
    groups = simhash._Groups()
    for r in links:
        groups.join(place[r.a], place[r.b])
    assert [groups.top(i) for i in range(len(fps))] == up


def test_blocks_leave_no_pair_out():
    for _, blocks in simhash.LAYOUTS:
        assert sum(distance + 1 for *_, distance in blocks) > simhash.DISTANCE
        covered = sorted(b for first, coded, plain, _ in blocks for b in range(first, first + coded + plain))
        assert covered == list(range(64))


def test_golay_covers_all_words():
    words, leader = simhash.golay()
    x = np.arange(1 << 23, step=97)
    error = leader[simhash._syndrome(x)]
    assert np.bitwise_count(error).max() <= 3
    assert np.isin(x ^ error, words).all()


def test_drop_near_copies_of_null_and_repeated_ids(spark):
    """One row a component, whatever its ids: a component of null ids has one, a null id gives way to another, and rows of one id are told apart by their texts."""
    a, b, c, d = "a b c d e f g", "one two three four five six", "u v w x y z", "k l m n o p q"
    rows = [(None, a), (None, a), (5, a), (None, b), (None, b), (7, c), (7, d), (6, c), (6, c), (8, d)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, text_hash int").repartition(3)
    kept = simhash.drop_near_copies(df).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, a), (None, b), (6, c), (7, d)], key=str)
    groups = simhash.near_groups(df).collect()
    assert len(groups) == len(rows) and {r.component_id for r in groups} == {5, None, 6, 7}


def test_drop_near_copies(docs, none, rows):
    fps = [fingerprint_brute(t) for _, t, *_ in rows]
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component_brute(fps)))
    assert simhash.near_groups(none).count() == 0 == simhash.drop_near_copies(none).count()


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 7), (30, 31), (31, 30), (50, 50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 0, 30: 30, 31: 30}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substrings


def substrings_brute(rows):
    seen, out = set(), {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        cover = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                cover[i : i + 20] = [True] * 20
            seen.add(w)
        kept = b" ".join(w for w, c in zip(words, cover, strict=True) if not c)
        out[doc_id] = (len(words), sum(cover), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize(("batch", "hot"), [(200_000, 32), (50, 1), (300, 2)])
def test_repeated_phrases(docs, rows, batch, hot, monkeypatch):
    # Small batches split routes over parts, and few places make marks frequent.
    monkeypatch.setattr(substrings, "BATCH", batch)
    monkeypatch.setattr(substrings, "HOT_PLACES", hot)
    monkeypatch.setattr(substrings, "HOT_SAMPLE", 16 if hot > 2 else 1)
    monkeypatch.setattr(substrings, "BUCKET_MARKS", 100 if hot == 2 else 1_000_000)
    want = substrings_brute(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
    assert got == {d: w[:3] for d, w in want.items()}
    assert sum(w[1] for w in want.values()) > 500


def test_repeated_phrases_of_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(None, f"{a} x"), (1, f"{a} y"), (1, f"{a} y"), (1, f"{b} z"), (2, f"q {b}"), (3, None), (None, None), (4, "")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, 0), (-1, 41, 0), (1, 41, 0), (1, 41, 40), (1, 41, 40), (2, 41, 40), (3, 0, 0), (4, 0, 0)]
    kept = sorted((r.doc_id or -1, r.text) for r in substrings.kept_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [(-1, ""), (-1, f"{a} x"), (1, f"{b} z"), (1, "y"), (1, "y"), (2, "q"), (3, ""), (4, "")]


def test_packed_columns():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(1 << 62), 1 << 62, 99), np.arange(99), np.full(99, 5), rng.integers(-5, 300, 99)]
    assert all((a == b).all() for a, b in zip(substrings.unpack(substrings.pack(*columns), 4), columns, strict=True))
    assert [len(x) for x in substrings.unpack(substrings.pack(np.zeros(0, np.int64), np.zeros(0, np.int64)), 2)] == [0, 0]


def test_kept_texts(docs, none, rows):
    want = {d: w[3] for d, w in substrings_brute(rows).items()}
    got = {r.doc_id: r.text for r in substrings.kept_texts(docs).collect()}
    assert all(got.get(d, "") == t for d, t in want.items())
    assert substrings.dedup_substrings(none).count() == 0 == substrings.kept_texts(none).count()


# Nearest neighbours


def search_brute(vectors, asked, k):
    good = [(i, np.array(v, float)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in asked:
        own = [v for i, v in good if i == q]
        if own:
            s = sorted((-(v @ own[0]) / (np.linalg.norm(v) * np.linalg.norm(own[0])), i) for i, v in dict(good).items() if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def test_search_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [float("inf")] + [1.0] * 15), (450, rows[0][1]), (500, rows[0][1])]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1)).withColumn("query", F.lit(2))
    data = {r.vec_id: r.embedding for r in df.select("vec_id", "embedding").collect()}
    got = {}
    for r in mih.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = search_brute(list(data.items()), [i for i in data if i % 50 == 0], 5)
    assert got.keys() == want.keys() and all(len(g) == 5 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, own in got.items():
        for i, s in own:
            a, b = np.array(data[q], float), np.array(data[i], float)
            assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
    # Ties among copies go to the smallest ids.
    assert [i for i, _ in got[1000]] == [7, 1001, 1002, 1003, 1004]


def test_search_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in mih.search(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert mih.search(df.limit(0), df.limit(0)).count() == 0


def test_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, (500, 1), np.uint64)
    codes = np.r_[codes, codes[:20] ^ np.uint64(0b10010001)]
    for bits in (8, 12):
        index = mih.Index(codes, bits)
        for q in codes[:20]:
            hit = np.zeros(len(codes), bool)
            for t in range(3):
                index.probe(mih.substrings(q[None], bits)[0], t, len(index.tables), hit)
                near = np.bitwise_count(codes[:, 0] ^ q[0]) <= len(index.tables) * (t + 1) - 1
                assert (hit | ~near).all()
            assert index.retrieve(q, np.ones(len(codes), int), len(codes), 0, 0).tolist() == list(range(len(codes)))


@pytest.mark.parametrize(("clusters", "most"), [(0, 0.33), (100, 0.05)])
def test_recall_and_share_of_rows_touched(clusters, most):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8000, 64))
    if clusters:
        x = rng.standard_normal((clusters, 64))[rng.integers(0, clusters, 8000)] + 0.2 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = mih.learn_rotations(x[:4096])
    codes = mih.encode(x, turn)
    last, slack = mih.learn_probing(x[:4096], codes[:4096], 5, 13)
    index = mih.Index(codes, 13)
    hits = touched = 0
    for q in range(0, 8000, 80):
        found = index.retrieve(codes[q], np.ones(len(x), int), 6, last, slack)
        best = np.argsort(-(x @ x[q]))[1:6]
        hits += np.isin(best, found).sum()
        touched += len(found)
    assert hits >= 0.95 * 500 and touched <= most * 100 * 8000, (hits / 500, touched / 800000, last, slack)


def test_search_of_other_lengths_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [2.0]), (3, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "class", "shard", "block", "ids", "salt")})
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in mih.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, round(1 / math.sqrt(1.01), 6)), (0, 3, 3, 0.0)]


# Licences


def test_licences(spark, docs, none):
    got = [(r.doc_id, r.license) for r in license_scan.scan(docs).collect()]
    last = max(r.doc_id for r in docs.select("doc_id").collect())
    assert got == [(last, "MIT")] and license_scan.scan(none).count() == 0


def test_licence_templates_are_found_in_text(spark):
    import random

    rnd = random.Random(1)
    noise = lambda n: " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        rows.append((i, f"{noise(50)} été.\n{text.upper()}\n{noise(37)}"))
        want.add((i, name))
        words = text.split()
        if len(words) > 24:  # one word changed spoils five shingles of many
            words[len(words) // 2] = "changed"
            rows.append((100 + i, f"{noise(11)} {' '.join(words)} {noise(5)}"))
            want.add((100 + i, name))
            rows.append((200 + i, " ".join(words[: len(words) // 2])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan(df).collect()
    assert want <= {(r.doc_id, r.license) for r in found}
    text = dict(rows)
    for r in found:
        assert r.containment >= 0.8 and text[r.doc_id][r.start : r.end].strip() == text[r.doc_id][r.start : r.end]


@pytest.mark.parametrize("times", [1, 2, 3, 100])
def test_license_notices_back_to_back(times):
    known = license_scan.Templates()
    for i, (_, text) in enumerate(license_scan.TEMPLATES):
        copies = " ".join([text] * times)
        got = sorted((a, b) for j, share, a, b in known.scan(copies) if j == i and share == 1)
        words = text.encode().rstrip(b" .:").__len__()
        assert got == [(k * (len(text.encode()) + 1), k * (len(text.encode()) + 1) + words) for k in range(times)], text


def test_stretched_license_notice_is_still_found():
    # Twelve words within the notice: longer than WIDER allows, but whole.
    text = license_scan.TEMPLATES[8][1].split()
    stretched = " ".join([*text[:16], *["word"] * 12, *text[16:]])
    assert [j for j, *_ in license_scan.Templates().scan(stretched)] == [8]


def test_signature_collides_as_often_as_promised():
    rng = np.random.default_rng(9)
    hits = 0
    for _ in range(200):
        both, a, b = rng.integers(0, 1 << 63, 10, np.uint64), rng.integers(0, 1 << 63, 5, np.uint64), rng.integers(0, 1 << 63, 5, np.uint64)
        x, y = license_scan.signature(np.r_[both, a]), license_scan.signature(np.r_[both, b])
        hits += bool((x == y).all(1).any())
    assert hits >= 199
