"""The pipeline's stages against brute force, and the registered queries."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, mixing, queries, toxicity
from tessera.llm.common import table

from .test_operators import PATH, component_brute, exact_brute, fingerprint_brute, substrings_brute

SF = "/root/testdata/sf0.001"


def test_stages_are_as_agreed():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]


def test_run(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs.filter(~toxicity.held_out()), table(spark, SF, "labels"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect() if score[r.doc_id] < 0.5)
    rows = [r for r in rows if exact_brute(rows)[r[0]][2]]
    top = component_brute([fingerprint_brute(t) for _, t, *_ in rows])
    rows = [r for i, r in enumerate(rows) if top[i] == i]
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    taken = {d: (t // n if n else 0) for d, n, _, _, t in con.sql(queries.OP6_SQL).fetchall()}
    cache = bpe.cache_for(bpe.MergeCache, PATH)
    want = collections.Counter()
    for d, t, *_ in rows:
        want[d, len(cache.encode([t])[0])] += taken[d]
    got = collections.Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    sized = {d for d, t, *_ in rows if t.split()}
    assert {k: v for k, v in got.items() if k[0] in sized} == {k: v for k, v in want.items() if v and k[0] in sized}


def test_odd_rows_through_all_stages(spark, docs, tmp_path):
    """Null, repeated and clashing ids, null and long texts and clashing columns, each row by hand through dedup, mixing and encoding (no labels, so nothing is toxic)."""
    odd = docs.unionByName(docs.filter("doc_id % 4 = 1")).unionByName(docs.filter("doc_id in (3, 9, 12)").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(docs.filter("doc_id = 20").withColumn("text", F.concat("text", F.lit(" and quite another end of it all that is long enough to be no copy"))))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    least = lambda d: (d is not None, d or 0)
    groups = collections.defaultdict(list)
    for row in rows:
        groups[(row[1] or "").encode().translate(None, b" \t\n\x0b\x0c\r")].append(row)
    kept = [min(own, key=lambda r: (-len(r[1] or ""), least(r[0]))) for own in groups.values()]
    # One of each component: a row with an id before one without, then the smallest.
    top = component_brute([fingerprint_brute(t) for _, t, _ in kept])
    parts = collections.defaultdict(list)
    for row, c in zip(kept, top, strict=True):
        parts[c].append(row)
    kept = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in parts.values()]
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", kept)
    rate = {s: t / n if n else 0 for s, n, t in con.sql(f"select distinct source, source_size, target from ({queries.OP6_SQL}) join documents using (doc_id)").fetchall()}
    library = Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    want = collections.Counter()
    for d, t, s in kept:
        draw = int(hashlib.md5(f"{mixing.SEED}|{'null' if d is None else d}".encode()).hexdigest()[:12], 16) / 2**48
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += math.floor(rate[s]) + (draw < rate[s] - math.floor(rate[s]))
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_repeated_phrases_of_the_table(spark):
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    want = {d: w[:3] for d, w in substrings_brute(rows).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_repeated_phrases(spark, SF).collect()} == want


def test_near_copies_of_the_table(spark):
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    top = component_brute([fingerprint_brute(t) for _, t in rows])
    assert {r.doc_id: r.component_id for r in queries.op4_simhash(spark, SF).collect()} == {rows[i][0]: rows[c][0] for i, c in enumerate(top)}


def test_language_of_held_out_rows(spark):
    out = queries.op8_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
