"""Queries over pages: markup, URLs, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch_path
from ..functions import text
from ..operators import dedup
from ..sources import paged
from .registry import Registry, table

registry = Registry()


@registry.add("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS body FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean_markup(F.col("html")).alias("body"))


@registry.add("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, length(html) AS n FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.length("html").alias("n"))


@registry.add("""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS canonical FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS rn FROM u)
SELECT host, count(*) AS pages, count(DISTINCT canonical) AS canonical_urls, min(page_id) FILTER (WHERE rn = 1) AS first_page FROM r GROUP BY host
""")
def url_dedup_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "/+$", "")
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), canonical.alias("canonical"))
    # URLs first, with partial sums, then hosts: no distinct count of all rows of a hot host in one step.
    by_url = u.groupBy("host", "canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return by_url.groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("canonical_urls"), F.min("first").alias("first_page"))


@registry.add("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY ALL")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@registry.add("""
WITH t AS (SELECT page_id, host, title FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) WHERE title <> '')
SELECT host, page_id, title FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY length(title) DESC, page_id) AS rn FROM t) WHERE rn = 1
""")
def longest_title_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).filter("title <> ''")
    return dedup.first_by(t, ["host"], [F.desc(F.length("title")), "page_id"]).select("host", "page_id", "title")


@registry.add("""
WITH p AS (SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages), kinds AS (SELECT * FROM (VALUES ('en', 'open', 3), ('fr', 'open', 1), ('de', 'closed', 5)) v(lang, licence, stars))
SELECT page_id, p.lang, coalesce(licence, 'unknown') AS licence, stars FROM p LEFT JOIN kinds USING (lang) WHERE lower(coalesce(licence, 'unknown')) IN ('open', 'unknown') AND coalesce(stars, 0) >= 1
""")
def licence_and_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A looked-up dimension, an allow-list and a floor."""
    kinds = spark.createDataFrame([("en", "open", 3), ("fr", "open", 1), ("de", "closed", 5)], "lang string, licence string, stars int")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))
    licence = F.coalesce("licence", F.lit("unknown"))
    return p.join(kinds, "lang", "left").filter(F.lower(licence).isin("open", "unknown") & (F.coalesce("stars", F.lit(0)) >= 1)).select("page_id", "lang", licence.alias("licence"), "stars")


TERMS = ("/en/", "/de/", "/fr/", "/es/", "blog.", "www.", ".net/")
TERM_ROWS = ", ".join(f"('{t}')" for t in TERMS)


@registry.add(f"""
SELECT url, min(page_id) AS page_id, count(DISTINCT query) AS queries FROM pages JOIN (VALUES {TERM_ROWS}) t(query) ON contains(url, query) WHERE page_id >= 0 GROUP BY url
""")
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven searches' recorded pages, read by the paged source in two parts (the second resumes behind the first's pages), one row for each url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    terms = F.explode(F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.col("url"), t)))
    folder = scratch_path(spark, "responses")
    paged.record(pages.select(terms.alias("query"), "page_id", "url"), folder)
    n = (pages.agg(F.max("page_id")).first()[0] or 0) // paged.PER_PAGE + 1
    first = paged.search(spark, folder, list(TERMS), n // 2)
    rest = paged.search(spark, folder, list(TERMS), n, {t: n // 2 - 1 for t in TERMS})
    return paged.by_url(first.union(rest))
