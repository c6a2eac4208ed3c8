"""Queries over records: merges, holdouts, replays, prompts, JSON in prose. Parts, suppliers and orders stand for records, batches and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records, scores, text
from ..operators import dedup, ranking, sampling
from ..sources import files
from .registry import Registry, table

registry = Registry()


@registry.add("SELECT o_custkey, (SELECT o_orderkey FROM orders f WHERE f.o_custkey = o.o_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_wins, (SELECT o_orderkey FROM orders f WHERE f.o_custkey = o.o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_wins FROM (SELECT DISTINCT o_custkey FROM orders) o")
def first_and_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same data merged by either rule."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(at)["o_orderkey"].alias("first_wins"), F.max(at)["o_orderkey"].alias("last_wins"))


@registry.add("""
WITH u AS (SELECT s_suppkey AS id, substr(s_name, 1, 16) AS k, round(s_acctbal, 1) AS b, 0 AS p FROM supplier UNION ALL SELECT c_custkey, substr(replace(c_name, 'Customer', 'Supplier'), 1, 16), round(c_acctbal, 1), 1 FROM customer)
SELECT k, b, CASE p WHEN 0 THEN 'curated-' ELSE 'mined-' END || id AS tag FROM (SELECT *, row_number() OVER (PARTITION BY k, b ORDER BY p, id) AS rn FROM u) WHERE rn = 1
""")
def merge_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources merged by (prefix of the text, rounded score), the first source first, ids tagged with where they are from."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.substring("s_name", 1, 16).alias("k"), F.round("s_acctbal", 1).alias("b"), F.lit("curated-").alias("tag"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.substring(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")), 1, 16).alias("k"), F.round("c_acctbal", 1).alias("b"), F.lit("mined-").alias("tag"))
    return dedup.union_distinct(s, c, key=F.struct("k", "b"), order=["id"]).select("k", "b", F.concat("tag", F.col("id").cast("string")).alias("tag"))


@registry.add("""
WITH held AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount = 0 AND l_tax = 0), o AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS parts FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(parts) AS n, NOT EXISTS (SELECT 1 FROM (SELECT unnest(parts) AS p) WHERE p IN (SELECT l_partkey FROM held)) AS clean FROM o
""")
def holdout_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a set of names, clean if none of them is held out: a semi join on the exploded names, so the holdout may be of any size."""
    li = table(spark, sf_dir, "lineitem")
    names = li.select("l_orderkey", "l_partkey").distinct()
    held = li.filter("l_discount = 0 and l_tax = 0").select("l_partkey").distinct()
    leaks = names.join(held, "l_partkey", "left_semi").select("l_orderkey").distinct().withColumn("leak", F.lit(True))
    return names.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(leaks, "l_orderkey", "left").select("l_orderkey", "n", F.col("leak").isNull().alias("clean"))


@registry.add("SELECT n_regionkey, n_name, place FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)) WHERE place <= 3")
def holdout_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each batch that training hasn't seen."""
    seen = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    fresh = table(spark, sf_dir, "nation").join(seen, "n_nationkey", "left_anti")
    return ranking.top_per_group(fresh, "n_regionkey", ["n_name"], 3, "place").select("n_regionkey", "n_name", "place")


@registry.add("SELECT s_suppkey, unnest(generate_series(1, CASE WHEN s_suppkey IN (1, 2, 3, 5, 8) THEN 16 ELSE 8 END)) AS copy FROM supplier")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.oversample(table(spark, sf_dir, "supplier").select("s_suppkey"), F.when(F.col("s_suppkey").isin(1, 2, 3, 5, 8), 16).otherwise(8))


@registry.add("""
WITH m AS (SELECT s_suppkey AS id, 'main' AS origin FROM supplier), x AS (SELECT c_custkey AS id, 'extra' AS origin FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT (SELECT greatest(floor(count(*) * 0.3 / (1 - 0.3))::BIGINT, 20) FROM supplier))
SELECT * FROM m UNION ALL SELECT * FROM x
""")
def ratio_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra rows up to a share of the whole, the first in hash order (a sampling operator)."""
    main = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("main").alias("origin"))
    return sampling.ratio_capped(main, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("extra").alias("origin")), "id")


@registry.add("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 99 END, p_size, p_partkey) AS place FROM part")
def curriculum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a brand by the rank of their kind (unknown last), then size: a stable curriculum."""
    rank = scores.rank_of(F.col("p_type"), {"ECONOMY": 0, "STANDARD": 1}, 99)
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(rank, "p_size", "p_partkey")).alias("place"))


@registry.add("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || '.' || chr(10) || p_type WHEN p_size % 3 = 1 THEN p_name || '.' ELSE p_type END AS text, CASE WHEN p_size % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE p_size % 3 WHEN 0 THEN 'index,comment' WHEN 1 THEN 'index' ELSE 'comment' END AS provenance FROM part")
def compose_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    d = records.composed(F.when(k != 2, F.col("p_name")), F.lit(None).cast("string"), F.when(k != 1, F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", d["text"].alias("text"), d["confidence"].alias("confidence"), F.array_join(d["provenance"], ",").alias("provenance"))


@registry.add("SELECT o_orderkey, 'r' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 1000000, 6) ELSE 0.0 END AS before FROM orders")
def repair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids out of prompts, scores joined on them, 0 where none is registered."""
    o = table(spark, sf_dir, "orders")
    prompt = records.repair_prompt(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")), F.lit("Repair this."), F.lit("x"), F.lit("y"))
    asked = o.select("o_orderkey", records.repair_id(prompt).alias("id"))
    known = o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), F.round(F.col("o_totalprice") / 1000000, 6).alias("score"))
    return asked.join(known, "id", "left").select("o_orderkey", "id", F.coalesce("score", F.lit(0.0)).alias("before"))


@registry.add("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_id % 2 = 0 THEN 'storage' ELSE 'other' END AS domain, greatest(1, least(5, TRY_CAST(json_extract_string(props, '$.k') AS INT))) AS difficulty FROM events")
def json_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object found in prose, then one of a full shape out of what there is."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    prose = F.concat(F.lit("Sure {not json} here: "), F.col("props"), F.lit(" done }"))
    shaped = F.concat(F.lit('{"domain": "'), F.when(F.col("event_id") % 2 == 0, "Storage").otherwise("unheard of"), F.lit('", "difficulty": '), k, F.lit("}"))
    e = e.select("event_id", records.first_json(prose).alias("found"), records.coerced(shaped).alias("d"))
    return e.select("event_id", F.get_json_object("found", "$.k").try_cast("int").alias("k"), "d.domain", "d.difficulty")


@registry.add("SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(p_name) < 20 THEN 'narrative too short' END, CASE WHEN p_size % 2 = 0 THEN 'no actions' END, 'no variables', CASE WHEN p_size % 3 > 0 THEN 'domain unknown' END], lambda x: x IS NOT NULL)) AS issue FROM part) GROUP BY issue")
def description_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_json(F.struct(F.col("p_name").alias("narrative"), F.when(F.col("p_size") % 3 == 0, "consensus").alias("domain"), F.struct(F.when(F.col("p_size") % 2 == 1, F.array(F.lit("go"))).alias("actions")).alias("technical")))
    return table(spark, sf_dir, "part").select(F.explode(records.description_errors(records.coerced(d))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@registry.add("SELECT n_nationkey AS name, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'clean ' || n_name END, CASE WHEN n_nationkey % 3 = 0 THEN 'original ' || n_name END) AS content, CASE WHEN n_nationkey % 5 = 0 THEN 'cfg' END AS cfg FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def manifest_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows with their files: the clean text, else the original; rows without either are left out."""
    n = table(spark, sf_dir, "nation").withColumn("name", F.col("n_nationkey"))
    part = lambda every, t: n.filter(F.col("n_nationkey") % every == 0).select("name", t.alias("text"))
    out = files.manifest(n.select("name"), part(2, F.concat(F.lit("clean "), "n_name")), part(3, F.concat(F.lit("original "), "n_name")), part(5, F.lit("cfg")), part(7, F.lit("c")))
    return out.select("name", "content", "cfg")


@registry.add("SELECT 'N' || n_nationkey AS dir, n_name AS title FROM nation")
def readme_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a markdown table, one text for each region, as pairs of folder and title."""
    row = F.concat(F.lit("| ["), F.col("n_name"), F.lit("](specifications/N"), F.col("n_nationkey").cast("string"), F.lit(") | x |"))
    readme = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(row), "\n").alias("text"))
    return readme.select(F.explode(text.dir_titles(F.col("text"))).alias("t")).select("t.dir", "t.title")


@registry.add("SELECT event_id, (event_id * 1000)::VARCHAR AS answer FROM events")
def worked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after #### in a worked answer, commas out."""
    worked = F.concat(F.lit("some steps 1 + 2\n#### "), F.format_number(F.col("event_id") * 1000, 0))
    return table(spark, sf_dir, "events").select("event_id", files.final_answer(worked).alias("answer"))


@registry.add("SELECT e.event_id, n_name FROM events e JOIN nation ON n_nationkey = e.event_id % 25")
def replicate_short_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short column repeated over a long one: an equi-join on the remainder."""
    n = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(25)).cast("int").alias("n_nationkey")).join(n, "n_nationkey").select("event_id", "n_name")


@registry.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing row of one model, in a stated order (the limit is the feature)."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return o.orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@registry.add("""
SELECT o_orderpriority AS model, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE / greatest(1, count(*)), 6) AS pass_rate, 'F=' || count(*) FILTER (WHERE o_orderstatus = 'F') || ',O=' || count(*) FILTER (WHERE o_orderstatus = 'O') || ',P=' || count(*) FILTER (WHERE o_orderstatus = 'P') AS by_tier, round(count(*) FILTER (WHERE o_totalprice > 400000)::DOUBLE / greatest(1, count(*)), 6) AS mismatch FROM orders GROUP BY 1
""")
def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and a map of counts by tier: the map is of the few tiers' sums, not of rows."""
    o = table(spark, sf_dir, "orders")
    by = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("m"))
    out = by.groupBy(F.col("o_orderpriority").alias("model")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("n")).otherwise(0)).alias("o"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n")))).alias("tiers"))
    shown = F.array_join(F.transform(F.map_entries("tiers"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("model", "n", F.round(F.col("o") / F.greatest(F.lit(1), "n"), 6).alias("pass_rate"), shown.alias("by_tier"), F.round(F.col("m") / F.greatest(F.lit(1), "n"), 6).alias("mismatch"))


@registry.add("SELECT p_partkey, round((p_size + p_partkey % 5 + 3) / 3.0, 6) AS avg_score, p_size + p_partkey % 5 + 3 >= 10.5 AS passes FROM part")
def mean_of_score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("clarity"), F.col("p_size").cast("double"), F.lit("depth"), (F.col("p_partkey") % 5).cast("double"), F.lit("style"), F.lit(3.0))
    mean = scores.map_mean(m)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(mean, 6).alias("avg_score"), (mean >= 3.5).alias("passes"))


@registry.add()
def condensed_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.condensed(F.col("p_name"), F.array("p_type", "p_brand"), F.lit("x = 0"), F.lit("")).alias("markdown"), records.plan_markdown(F.col("p_brand"), F.array("p_type"), F.array(F.struct(F.col("p_name").alias("name"), F.lit("g").alias("guard"), F.lit("e").alias("effect")))).alias("plan"), text.humanised(F.lit("HTTPServerLog_v2")).alias("human"), text.drop_repeated_tail(F.array_join(F.array_repeat(F.col("p_name"), 12), "\n")).alias("trimmed"))


@registry.add(r"SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'id mismatch' END, CASE WHEN o_orderkey % 3 = 0 THEN 'source missing' END], lambda x: x IS NOT NULL)::VARCHAR AS errors FROM orders")
def record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import content_id

    content = F.col("o_orderpriority")
    id_ = F.when(F.col("o_orderkey") % 2 == 0, "wrong").otherwise(content_id(content))
    errors = records.record_errors(id_, content, F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("s"))
    sorted_ = F.concat(F.lit("["), F.array_join(F.array_sort(errors), ", "), F.lit("]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sorted_.alias("errors"))
