"""Queries over documents, labels and benchmark: dedup, scoring, selection, splits, decontamination, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, stored
from ..functions import scores, text
from ..operators import dedup, near_links, ranking, retrieval, sampling, selection
from .registry import Registry, table

registry = Registry()

# Pieces of SQL that several oracles share.
ID = r"sha256(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
EXACT = f"firsts AS (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY doc_id) AS rn FROM documents), kept AS (SELECT * FROM firsts WHERE rn = 1)"
N_WORDS = f"len({TOKENS})"


def words(c: str = "text"):
    return F.size(text.tokens(F.col(c)))


@registry.add(f"WITH {EXACT} SELECT doc_id, {ID} AS content_id, substr({ID}, 1, 16) AS short_id, substr(md5(text), 1, 12) AS md5_id FROM kept")
def exact_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    kept = dedup.exact_first(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", text.content_id(t).alias("content_id"), F.substring(text.content_id(t), 1, 16).alias("short_id"), text.short_hash(t, 12, "md5").alias("md5_id"))


@registry.add(f"""
WITH ids AS (SELECT *, {ID} AS id FROM documents),
fresh AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS rn FROM ids WHERE source <> 'src0' AND id NOT IN (SELECT id FROM ids WHERE source = 'src0'))
SELECT doc_id, source, false AS from_seed FROM fresh WHERE rn = 1
UNION ALL SELECT min(doc_id), 'src0', true FROM ids WHERE source = 'src0' GROUP BY id
""")
def seed_anchored_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seed, rest = docs.filter("source = 'src0'"), docs.filter("source <> 'src0'")
    fresh = dedup.seed_anchored(seed, rest)
    # Seed first, then what is new: a union that is distinct by content.
    both = dedup.union_distinct(seed.withColumn("from_seed", F.lit(True)), fresh.withColumn("from_seed", F.lit(False)), key=text.content_id(F.col("text")), order=["doc_id"])
    return both.select("doc_id", "source", "from_seed")


@registry.add()
def seed_anchored_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed_anchored_dedup with near copies: the seed's contents, and the rows that an in-order filter keeps after it."""
    docs = table(spark, sf_dir, "documents")
    seed, rest = docs.filter("source = 'src0'"), docs.filter("source <> 'src0'")
    kept = rest.join(dedup.seed_anchored_near(seed, rest, stored), "doc_id", "left_semi")
    anchor = dedup.exact_first(seed)
    return anchor.select("doc_id", "source", F.lit(True).alias("from_seed")).union(kept.select("doc_id", "source", F.lit(False)))


@registry.add(f"""
WITH {EXACT}, sets AS (SELECT doc_id, list_sort(list_distinct({TOKENS})) AS s FROM kept),
classes AS (SELECT min(doc_id) AS id, s FROM sets WHERE len(s) > 0 GROUP BY s), tok AS (SELECT id, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM tok a JOIN tok b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY 1, 2)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM pairs WHERE k / (na + nb - k) >= 0.8
""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal token sets, over all documents."""
    return dedup.token_links(table(spark, sf_dir, "documents")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@registry.add(f"""
WITH sets AS (SELECT doc_id, list_sort(list_distinct({TOKENS})) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS class_size FROM sets
""")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of every document in its class of equal token sets, the other half of near_dup_pairs."""
    sets = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(F.array_sort(text.token_set(F.col("text"))), "\x00"), 256).alias("digest"))
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return sets.join(classes, "digest").select("doc_id", "class_id", "class_size")


@registry.add()
def near_dup_online_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents an in-order filter keeps: not linked to any kept before. Rows of one token set follow their first."""
    docs = table(spark, sf_dir, "documents")
    links = stored(dedup.token_links(docs).select("a", "b"))
    # Copies by content have one token set, as have rows without a token.
    first = stored(docs.groupBy(near_links.set_digest(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("id")).select("id"))
    linked = first.join(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "id", "left_semi")
    free = first.join(linked, "id", "left_anti")
    return dedup.online_keep(linked, links, stored).filter("kept").select(F.col("id").alias("doc_id")).union(free)


@registry.add()
def near_dup_lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact links, and how many of them share a band of a layout solved for 0.95 at the threshold."""
    docs = table(spark, sf_dir, "documents")
    links = stored(dedup.token_links(docs).select("a", "b"))
    ends = near_links.few(stored(links.select(F.col("a").alias("id")).union(links.select("b")).distinct()))
    sets = docs.select(F.col("doc_id").alias("id"), "text").join(ends, "id", "left_semi").select("id", text.token_set(F.col("text")).alias("set"))
    found = dedup.links_found(links, stored(dedup.band_keys(sets, *dedup.band_layout(0.8, 0.95))))
    return links.agg(F.count("*").alias("linked")).crossJoin(found.agg(F.count("*").alias("found")))


BAND = "CASE WHEN n_words < 50 THEN 'short' WHEN n_words < 300 THEN 'medium' ELSE 'long' END"


@registry.add(f"""
WITH d AS (SELECT *, {N_WORDS} AS n_words, len(regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\n')) AS n_lines, len(list_distinct({TOKENS})) AS n_distinct FROM documents),
r AS (SELECT doc_id, n_words, CASE WHEN length(text) = 0 THEN 0 ELSE n_lines END AS n_lines, n_distinct,
  CASE WHEN n_words BETWEEN 100 AND 5000 THEN 2 WHEN n_words BETWEEN 30 AND 99 THEN 1 ELSE 0 END + CASE WHEN n_lines >= 3 THEN 1 ELSE 0 END + CASE WHEN n_distinct >= 0.5 * n_words THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[.!?]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[$&%#*]{{3}}') THEN 0 ELSE 2 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END
  + CASE WHEN length(text) >= 200 THEN 1 ELSE 0 END AS raw FROM d)
SELECT doc_id, n_words, n_lines, n_distinct, raw, greatest(1, least(5, round_even(raw / 2.0, 0)))::INT AS overall, {BAND} AS band FROM r
""")
def quality_score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0-10 to 1-5 quality scale, generalised from specifications to documents; halves round to even."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", t, words().alias("n_words"), text.line_count(t).alias("n_lines"), F.size(text.token_set(t)).alias("n_distinct"))
    on = lambda c, w: F.when(c, w).otherwise(0)
    n = F.col("n_words")
    raw = F.when(n.between(100, 5000), 2).when(n.between(30, 99), 1).otherwise(0) + on(F.size(F.split(F.regexp_replace(t, "\n$", ""), "\n")) >= 3, 1) + on(F.col("n_distinct") >= 0.5 * n, 2)
    raw = raw + on(t.rlike("[.!?]"), 1) + F.when(t.rlike("[$&%#*]{3}"), 0).otherwise(2) + on(t.rlike("[0-9]"), 1) + on(F.length(t) >= 200, 1)
    overall = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.col("raw") / 2, 0).cast("int")))
    band = F.when(n < 50, "short").when(n < 300, "medium").otherwise("long")
    return d.withColumn("raw", raw).select("doc_id", "n_words", "n_lines", "n_distinct", "raw", overall.alias("overall"), band.alias("band"))


REASON = f"CASE WHEN trim(text) = '' THEN 'empty' WHEN {N_WORDS} < 20 THEN 'too_short' WHEN regexp_matches(text, '[$&%#*]{{3}}') THEN 'junk' WHEN len(list_distinct({TOKENS})) < 0.3 * {N_WORDS} THEN 'repetitive' WHEN NOT regexp_matches(text, '[.!?]') THEN 'bad_structure' ELSE 'kept' END"


def reject_reason():
    t, n = F.col("text"), words()
    return F.when(F.trim(t) == "", "empty").when(n < 20, "too_short").when(t.rlike("[$&%#*]{3}"), "junk").when(F.size(text.token_set(t)) < 0.3 * n, "repetitive").when(~t.rlike("[.!?]"), "bad_structure").otherwise("kept")


@registry.add(f"SELECT {REASON} AS reason, count(*) AS n, round(avg(n_chars), 4) AS avg_chars FROM documents GROUP BY 1")
def reject_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered expression gives the first reason that holds; then a count by reason."""
    return table(spark, sf_dir, "documents").withColumn("reason", reject_reason()).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


TOPIC = "CASE WHEN contains(l, 'the') AND contains(l, 'and') THEN 'both' WHEN contains(l, 'the') THEN 'the' WHEN contains(l, 'de') THEN 'de' ELSE 'other' END"


@registry.add(f"""
WITH {EXACT}, t AS (SELECT doc_id, n_chars, {TOPIC} AS topic FROM (SELECT *, lower(text) AS l FROM kept)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n_chars DESC, doc_id) AS rk FROM t)
SELECT doc_id, topic, n_chars, CASE WHEN rk <= 15 THEN 0 ELSE 1 END AS phase FROM r ORDER BY phase, n_chars DESC, doc_id LIMIT 120
""")
def quota_topic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 15 documents a topic in global order, then the rest in order, 120 in all (the limit is the feature)."""
    low = F.lower("text")
    topic = F.when(F.contains(low, F.lit("the")) & F.contains(low, F.lit("and")), "both").when(F.contains(low, F.lit("the")), "the").when(F.contains(low, F.lit("de")), "de").otherwise("other")
    d = dedup.exact_first(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", topic.alias("topic"))
    return ranking.quota_then_fill(d, "topic", [F.desc("n_chars"), "doc_id"], 15, 120)


@registry.add(f"""
WITH t AS (SELECT doc_id, source, lang, {N_WORDS} AS n FROM documents)
SELECT source, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 3 WHEN 'de' THEN 2 ELSE 1 END DESC, n DESC, doc_id) AS rn FROM t) WHERE rn = 1
""")
def best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each source by (rank of the language, words), the first of equals."""
    rank = scores.rank_of(F.col("lang"), {"en": 4, "fr": 3, "de": 2}, 1)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", rank.alias("r"), words().alias("n"))
    return ranking.best_per_key(d, "source", [F.col("r"), F.col("n")], "doc_id").select("source", "doc_id", "n")


@registry.add(f"""
WITH h AS (SELECT doc_id, source, n_chars, substr({ID}, 1, 16) AS h FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY n_chars DESC, doc_id) AS one FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM d WHERE one = 1)
SELECT source, doc_id, n_chars, rank, rank - 1 AS variant FROM r WHERE rank <= 3
""")
def top3_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the three longest documents of different content, numbered."""
    h = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", text.short_hash(text.strip(F.col("text")), 16).alias("h"))
    one = dedup.first_by(h, ["source", "h"], [F.desc("n_chars"), "doc_id"])
    return ranking.top_per_group(one, "source", [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", "n_chars", "rank", (F.col("rank") - 1).alias("variant"))


@registry.add("""
WITH s AS (SELECT source, doc_id, quality * 0.5 + CASE WHEN toxic = 0 THEN 0.4 ELSE 0 END AS reward FROM documents JOIN labels USING (doc_id)),
x AS (SELECT source, max(reward) AS hi, min(reward) AS lo FROM s GROUP BY source)
SELECT source, (SELECT min(doc_id) FROM s WHERE s.source = x.source AND reward = hi) AS best, (SELECT min(doc_id) FROM s WHERE s.source = x.source AND reward = lo) AS worst, hi AS best_value, lo AS worst_value
FROM x WHERE hi - lo >= 0.05
""")
def best_worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the best and the worst labelled document where rewards are 0.05 apart at least."""
    s = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    s = s.select("source", "doc_id", (F.col("quality") * 0.5 + F.when(F.col("toxic") == 0, 0.4).otherwise(0.0)).alias("reward"))
    return ranking.best_and_worst(s, "source", "reward", "doc_id", 0.05)


@registry.add(f"""
WITH s AS (SELECT source, doc_id, n_chars::DOUBLE AS reward, substr(md5(text), 1, 12) AS h FROM documents),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY reward DESC, doc_id) AS rn FROM s) WHERE rn = 1),
r AS (SELECT s.source, b.doc_id AS chosen, b.reward AS chosen_value, s.doc_id AS rejected, s.reward AS rejected_value, row_number() OVER (PARTITION BY s.source ORDER BY s.reward, s.doc_id) AS rank FROM s JOIN b USING (source) WHERE s.h <> b.h AND b.reward - s.reward >= 0.01)
SELECT * FROM r WHERE rank <= 3
""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").cast("double").alias("reward"), text.short_hash(F.col("text"), 12, "md5").alias("h"))
    return ranking.best_against_worst(s, "source", "reward", "doc_id", "h")


@registry.add("""
SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS tidy, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10) || '[truncated]' ELSE text END AS capped,
  CASE WHEN length(text) > 80 THEN '...' || right(text, 80) ELSE text END AS tail, substr(text, 1, 500) AS preview,
  array_to_string(regexp_split_to_array(text, '\\n')[1:12], chr(10)) AS head
FROM documents
""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_blank_lines(t).alias("tidy"), text.capped(t, 300).alias("capped"), text.tail(t, 80).alias("tail"), text.preview(t, 500).alias("preview"), text.head_lines(t, 12).alias("head"))


@registry.add("SELECT d.doc_id, min(b.item_id) AS item_id, count(*) AS n_items FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def decontam_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's text. Items meet only documents that share six words (or an inner word of a short item); then the whole text is looked for."""
    return _leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))


#: Keys of items that are broadcast as one set; more are joined.
MOST_KEYS = 1 << 16


def _leaks(docs: DataFrame, items: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(doc_id, item_id) where the document holds the item's whole text: an equi-join on a hash, then the test.

    The second to seventh words of an item of nine words or more stand whole in any document that holds
    it, and so does the longest inner word of one of three or more. Documents keep only hashes that are
    an item's before any row is made of them. Items of one or two words may begin and end within words,
    so they meet every document, up to MOST_KEYS of them by a broadcast.
    """
    ws = F.split(F.col("text"), r"\s+")
    keyed = items.select("item_id", F.col("text").alias("item"), ws.alias("ws"))
    longest = F.array_max(F.transform(F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    key = F.when(F.size("ws") >= 9, F.xxhash64(F.lit(6), F.array_join(F.slice("ws", 2, 6), " "))).when(F.size("ws") >= 3, F.xxhash64(F.lit(1), longest))
    keyed = checkpointed(keyed.select("item_id", "item", key.alias("key")))
    sixes = F.coalesce(F.transform(text.phrases(ws, 6), lambda p: F.xxhash64(F.lit(6), p)), F.array().cast("array<long>"))
    hashes = F.array_union(sixes, F.transform(ws, lambda w: F.xxhash64(F.lit(1), w)))
    keys = keyed.filter("key is not null").select("key").distinct()
    own = docs.select(id_, hashes.alias("hashes"))
    if keys.count() <= MOST_KEYS:
        own = own.crossJoin(F.broadcast(keys.agg(F.collect_set("key").alias("keys")))).select(id_, F.array_intersect("hashes", "keys").alias("hashes"))
    candidates = own.select(id_, F.explode("hashes").alias("key")).join(keyed.select("key", "item_id"), "key").select(id_, "item_id").distinct()
    found = docs.select(id_, "text").join(candidates, id_).join(items.select("item_id", F.col("text").alias("item")), "item_id").filter(F.contains("text", "item")).select(id_, "item_id")
    few = keyed.filter("key is null").select("item_id", "item")
    n = few.count()
    if not n:
        return found
    short = docs.select(id_, "text").join(F.broadcast(few) if n <= MOST_KEYS else few, F.contains("text", "item")).select(id_, "item_id")
    return found.union(short)


@registry.add(rf"""
WITH phrases AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i:i+7], ' ')))) AS p FROM (SELECT doc_id, {TOKENS} AS w FROM documents)),
items AS (SELECT DISTINCT unnest(list_transform(generate_series(1, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i:i+7], ' '))) AS p FROM (SELECT {TOKENS} AS w FROM benchmark))
SELECT d.doc_id, d.lang, coalesce(h.n, 0) AS shared, coalesce(h.n, 0) = 0 AS clean FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM phrases JOIN items USING (p) GROUP BY doc_id) h USING (doc_id)
""")
def decontam_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of eight-word phrases it shares with the benchmark; clean if none."""

    def phrases(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, F.explode(text.phrases(text.tokens(F.col("text")), 8)).alias("p"))

    docs = table(spark, sf_dir, "documents")
    shared = phrases(docs, "doc_id").join(phrases(table(spark, sf_dir, "benchmark")).distinct(), "p", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return docs.select("doc_id", "lang").join(shared, "doc_id", "left").select("doc_id", "lang", n.alias("shared"), (n == 0).alias("clean"))


@registry.add(f"""
WITH h AS (SELECT doc_id, lang, {BAND} AS band, md5('42|' || doc_id) AS h FROM (SELECT *, {N_WORDS} AS n_words FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, band ORDER BY h, doc_id) AS rn, count(*) OVER (PARTITION BY lang, band) AS n FROM h)
SELECT doc_id, lang, band, CASE WHEN rn <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS split FROM r
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_words")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", words().alias("n_words")).withColumn("band", F.when(n < 50, "short").when(n < 300, "medium").otherwise("long"))
    return sampling.stratified_split(d, [F.col("lang"), F.col("band")], "doc_id").select("doc_id", "lang", "band", "split")


@registry.add("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN n >= 4 AND rn <= greatest(1, round_even(n * 0.1, 0)) THEN 'eval' ELSE 'train' END AS split FROM r
""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@registry.add("""
WITH d AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS k, 'labelled' AS origin FROM labels),
u AS (SELECT doc_id, 1 AS k, 'plain' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang = 'en')
SELECT doc_id, origin, unnest(generate_series(1, k)) AS copy FROM (SELECT * FROM d UNION ALL SELECT * FROM u) WHERE k > 0
""")
def oversample_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of quality twice, toxic ones never, unlabelled English ones once: a union of unlike sources, then replication."""
    labels = table(spark, sf_dir, "labels").withColumn("origin", F.lit("labelled"))
    plain = table(spark, sf_dir, "documents").filter("lang = 'en'").join(labels, "doc_id", "left_anti").select("doc_id", F.lit("plain").alias("origin"))
    times = F.when(F.col("origin") == "plain", 1).when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return sampling.oversample(labels.unionByName(plain, allowMissingColumns=True), times).select("doc_id", "origin", "copy")


@registry.add("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unjudged' WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS verdict, (l.doc_id IS NOT NULL AND toxic = 0 AND quality * 4.0 >= 3.5) AS kept, coalesce(quality * 4.0, 0) AS score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def judge_threshold_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the judge's threshold; unjudged rows are rejected."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    judged = F.col("quality").isNotNull()
    return d.select("doc_id", F.when(~judged, "unjudged").when(F.col("toxic") == 1, "reject").otherwise("accept").alias("verdict"), F.coalesce(judged & (F.col("toxic") == 0) & (F.col("quality") * 4.0 >= 3.5), F.lit(False)).alias("kept"), F.coalesce(F.col("quality") * 4.0, F.lit(0.0)).alias("score"))


@registry.add("""
WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 4) AS mean, quantile_cont(n_chars, 0.5) AS p50 FROM documents GROUP BY lang)
SELECT lang, lo, hi, mean, v[len(v) // 2 + 1] AS upper_median, p50, v[floor(0.9 * len(v))::INT + 1] AS p90 FROM s
""")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min, max, mean, upper median (sorted[n // 2]), interpolated median and sorted[int(0.9 n)]: ranks selected exactly, no language's rows are ranked or gathered in one task."""
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    places = lambda n: (F.floor(n / 2) + 1, F.floor((n - 1) / 2) + 1, F.floor(0.9 * n) + 1)  # noqa: E731  upper median, lower median, p90
    found = selection.at_ranks(d, [F.col("lang")], selection.order_key(F.col("n_chars")), 16, lambda n: F.array(*places(n)))
    value = selection.from_order_key(F.col("key"))
    upper, lower, p90 = (F.max(F.when(F.col("rank") == p, value)) for p in places(F.col("n")))
    ranks = found.groupBy("group").agg(upper.alias("upper_median"), ((upper + lower) / 2).alias("p50"), p90.alias("p90"))
    whole = d.groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 4).alias("mean")).withColumn("group", selection.group_key([F.col("lang")]))
    return whole.join(ranks, "group").select("lang", "lo", "hi", "mean", "upper_median", "p50", "p90")


RAW_TERMS = r"regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+')"
STOP = ", ".join(f"'{w}'" for w in sorted(set(text.STOP_WORDS)))
TERMS = f"list_transform(list_filter({RAW_TERMS}, lambda w: w NOT IN ({STOP})), lambda w: lower(w))"


@registry.add(f"""
WITH d AS (SELECT doc_id, {TERMS} AS terms FROM documents), s AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS n FROM p GROUP BY term),
r AS (SELECT query_id, doc_id, round(sum(times * ln((n_docs - n + 0.5) / (n + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 3
""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries against all documents."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(table(spark, sf_dir, "documents"), queries)


@registry.add()
def bm25_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context blocks of the best documents' snippets."""
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.context_block(retrieval.hits(retrieval.bm25(docs, queries), docs))


@registry.add("""
WITH s AS (SELECT item_id AS id, list_distinct(list_filter(regexp_split_to_array(text, '[;, ]+'), lambda w: length(w) > 1)) AS s FROM benchmark),
t AS (SELECT id, len(s) AS n, unnest(s) AS w FROM s),
p AS (SELECT a.id AS a, b.id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 3) AS score FROM t a JOIN t b ON a.w = b.w AND a.id <> b.id GROUP BY 1, 2)
SELECT * FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) AS rank FROM p) WHERE rank <= 5
""")
def jaccard_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest benchmark items of each by the Jaccard similarity of their row terms, ties to the higher id."""
    sets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.row_terms(F.col("text")).alias("set"))
    return retrieval.jaccard_neighbours(sets)


@registry.add("""
WITH s AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(text, '[;, ]+'), lambda w: length(w) > 1)) AS s FROM documents),
t AS (SELECT id, len(s) AS n, unnest(s) AS w FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM t a JOIN t b ON a.w = b.w AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2)
SELECT * FROM (SELECT a, b, round(score, 3) AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) AS rank FROM p) WHERE rank <= 5
""")
def jaccard_knn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_knn over documents: those whose id is divisible by 20 as queries, against all. Ranked before rounding."""
    sets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.row_terms(F.col("text")).alias("set"))
    return retrieval.jaccard_search(sets, sets.filter(F.col("id") % 20 == 0))


@registry.add(f"""
SELECT source, count(*) AS total, count(*) FILTER (WHERE toxic IS NOT NULL) AS judged, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean
FROM (SELECT 'src' || substr(split_part(source, 'src', 2), 1, 1) AS source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ROLLUP(source)
""")
def funnel_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the stages of a funnel by the source's prefix, and for all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.withColumn("source", F.concat(F.lit("src"), F.substring(F.split_part("source", F.lit("src"), F.lit(2)), 1, 1)))
    good = F.col("quality") == 1
    return d.rollup("source").agg(F.count("*").alias("total"), F.count("toxic").alias("judged"), F.count_if(good).alias("good"), F.count_if(good & (F.col("toxic") == 0)).alias("clean"))


@registry.add(f"""
WITH r AS (SELECT doc_id, list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN regexp_matches(text, '[$&%#*]{{3}}') THEN 'junk' END, CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL) AS errors FROM documents)
SELECT issue, count(*) AS n FROM (SELECT unnest(errors) AS issue FROM r) GROUP BY issue
""")
def validity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several errors a record, exploded and counted."""
    t = F.col("text")
    errors = F.array_compact(F.array(F.when(F.length(t) < 200, "short"), F.when(t.rlike("[$&%#*]{3}"), "junk"), F.when(F.contains(t, F.lit("@")), "address"), F.when(F.col("lang") != "en", "foreign")))
    return table(spark, sf_dir, "documents").select(F.explode(errors).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@registry.add(f"""
WITH {EXACT}, good AS (SELECT k.doc_id, k.source, k.lang, k.n_chars FROM kept k LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0 AND {REASON} = 'kept'),
leak AS (SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM good WHERE doc_id NOT IN (SELECT doc_id FROM leak))
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE rk <= 15) AS in_quota FROM r GROUP BY lang
""")
def curated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: exact dedup, reject cascade, judgments, benchmark leaks out, quota by source, a summary by language."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    kept = dedup.exact_first(docs).withColumn("reason", reject_reason()).filter("reason = 'kept'").join(toxic, "doc_id", "left_anti")
    leaks = _leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    good = checkpointed(kept.join(leaks, "doc_id", "left_anti").select("doc_id", "source", "lang", "n_chars"))
    longest_first = F.concat(selection.order_key(-F.col("n_chars")), selection.order_key(F.col("doc_id")))
    ranked = selection.first_of_groups(good, [F.col("source")], longest_first, 32, lambda n: F.lit(15), "in_quota")
    return ranked.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if("in_quota").alias("in_quota"))


@registry.add("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by the order of a seeded hash (a sampling operator)."""
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, "7")


@registry.add("""
WITH b AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'anchor' WHEN lang = 'de' THEN 'hard' ELSE 'rest' END AS bank FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM b)
SELECT doc_id, bank FROM r WHERE rn <= CASE bank WHEN 'anchor' THEN 20 WHEN 'hard' THEN 30 ELSE 50 END
""")
def bank_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = F.when(F.col("lang") == "en", "anchor").when(F.col("lang") == "de", "hard").otherwise("other")
    return sampling.bank_sample(table(spark, sf_dir, "documents"), bank, "doc_id", {"anchor": 0.2, "hard": 0.3}, 100).select("doc_id", "bank")


@registry.add("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 15 AS batch_id FROM documents")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of fifteen in order of id, numbered over a range sort."""
    return sampling.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 15).select("doc_id", "batch_id")
