"""Queries opN_<name>, each its operator applied to the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, license_scan, mih, mixing, prefix_trie, simhash, spelling, substrings, token_store, toxicity, url_filters
from .common import id_crc, scratch_path, table

VOCABULARY = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels of rows that aren't held out."""
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents, with their spans."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return mih.search(rows, rows.filter("vec_id % 50 = 0"), 5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without words of repeated windows."""
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(True))
    langs, cells = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, langs, cells, F.col("doc_id"), held_out.alias("held_out"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and checksums of all documents, read back from the store."""
    folder = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return token_store.read_sums(spark, folder)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for each document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


#: Host, path and verdict of op11's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages by RULES, allowed where none fits."""
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(RULES, "host string, path string, verdict string")).drop("url")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each grafted on the first turns of its group's first."""
    return prefix_trie.trie(prefix_trie.graft(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_multi_index_hashing, op4_simhash, op5_repeated_phrases, op6_mixing, op7_bpe, op8_language, op9_token_store, op10_exact_dedup, op11_url_filters, op12_prefix_trie, op13_spelling_variants)}


OP6_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END::DOUBLE AS weight,
    source_size * {mixing.LIMIT}::DOUBLE AS cap, (SELECT sum(source_size) FROM sources) * {mixing.SHARE}::DOUBLE AS total
  FROM sources
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, (total - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER rest AS level FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT arg_min(level, place) FILTER (WHERE level * weight <= cap) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(cap, weight * level) AS target, CASE WHEN source_size > 0 THEN least(cap, weight * level) / source_size ELSE 0 END AS rate FROM weighed, level
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN ('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT / {float(1 << 48)} < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""

OP10_SQL = """
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""


OP11_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rests AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS named FROM rests
), parts AS (
  SELECT page_id, translate(named, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(named) + 1), '^[^?#]*') AS path FROM hosts
)
SELECT page_id, host, path,
  (SELECT arg_max(r_host || r_path, length(r_host || r_path)) FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
  coalesce((SELECT arg_max(r_verdict, length(r_host || r_path)) FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
FROM parts
"""


def _crc32(codes: str) -> str:
    """SQL of the unsigned crc32 of a list of bytes."""
    step = "xor(a >> 1, (a & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda a, i: {step})), 4294967295::BIGINT)"


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests, list(size ORDER BY turn NULLS FIRST, digest) AS sizes FROM turns GROUP BY conv_id
), heads AS (
  SELECT *, {_crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h FROM convs
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.digests[1:c.h], []), c.digests[c.h + 1:]) AS digests, list_concat(coalesce(b.sizes[1:c.h], []), c.sizes[c.h + 1:]) AS sizes
  FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
), places AS (
  SELECT conv_id, unnest(range(len(digests) + 1)) AS depth, digests, sizes FROM built
), paths AS (
  SELECT conv_id, depth, sha256(array_to_string(digests[1:depth], '')) AS path, CASE WHEN depth > 0 THEN sha256(array_to_string(digests[1:depth - 1], '')) END AS up,
    CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size, depth = len(digests) AS ends, digests FROM places
), nodes AS (
  SELECT path, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ids FROM paths GROUP BY path, depth
), children AS (
  SELECT up AS path, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), own AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children, (n_convs - 1) * size AS saved FROM nodes LEFT JOIN children USING (path)
), below AS (
  SELECT DISTINCT a.path AS top, b.path AS path FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT top AS path, sum(CASE WHEN own.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM below JOIN own USING (path) GROUP BY top
)
SELECT own.conv_id, own.depth, parent.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(own.ids, '')) AS ends_sha256
FROM own JOIN sums USING (path) LEFT JOIN own parent ON parent.path = own.up
"""

OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
), counted AS (
  SELECT doc, run, count(*) AS times FROM runs WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY ALL
), hashed AS (
  SELECT run, times, {_crc32("list_transform(flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)), lambda x: x::BIGINT)")} AS h FROM counted
), cut AS (
  SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(times) >= {spelling.LEAST_COUNT}
), rests AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words
), gone AS (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM rests
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, (list(near ORDER BY n DESC, near))[1] AS near, max(n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.TIMES} * n THEN near END AS form, CASE WHEN near_n >= {spelling.TIMES} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)
), led AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT led.word, forms.form FROM led JOIN forms ON led.root = forms.word WHERE forms.form IS NOT NULL
)
SELECT forms.word, forms.form, led.root, forms.n, forms.n_near, forms.form_n FROM forms JOIN led USING (word) JOIN forms last ON last.word = led.root WHERE last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """Op 1 to 5 and 7 to 9 learn a model, hash, or call a library that SQL hasn't; tests/llm holds them against brute force."""
    return {"op6_mixing": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_url_filters": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_spelling_variants": OP13_SQL}
