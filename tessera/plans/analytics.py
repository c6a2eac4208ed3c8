"""Queries over results and histories: rates, intervals, windows, joins, pivots. Days stand for cycles, event types for models, orders for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import dedup, ranking
from .registry import Registry, table

registry = Registry()
Z = scores.Z95

RESULTS = "results AS (SELECT o_orderkey AS id, o_orderpriority AS model, CASE WHEN o_custkey % 2 = 0 THEN 'single' ELSE 'piecewise' END AS regime, least(4, greatest(0, (o_orderkey * 7 + o_custkey) % 6)) AS tier, o_orderstatus AS status, o_totalprice AS price FROM orders)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as benchmark results: model, regime, tier clamped to 0-4."""
    tier = F.least(F.lit(4), F.greatest(F.lit(0), (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 6))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("model"), F.when(F.col("o_custkey") % 2 == 0, "single").otherwise("piecewise").alias("regime"), tier.alias("tier"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


LOW = f"greatest(0, (p + {Z * Z} / (2.0 * n)) / (1 + {Z * Z} / n) - {Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n))"
HIGH = f"least(1, (p + {Z * Z} / (2.0 * n)) / (1 + {Z * Z} / n) + {Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n))"


@registry.add(f"""
WITH {RESULTS}, h AS (SELECT model, regime, count(*) FILTER (WHERE tier = 0) AS t0, count(*) FILTER (WHERE tier = 1) AS t1, count(*) FILTER (WHERE tier = 2) AS t2, count(*) FILTER (WHERE tier = 3) AS t3, count(*) FILTER (WHERE tier = 4) AS t4, count(*) AS n FROM results GROUP BY ALL),
r AS (SELECT *, t4::DOUBLE / n AS p FROM h)
SELECT model, regime, t0, t1, t2, t3, t4, n, round(p, 6) AS rate, round({LOW}, 6) AS low, round({HIGH}, 6) AS high FROM r
""")
def tier_histogram_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("tier") == i).alias(f"t{i}") for i in range(5)]
    h = results(spark, sf_dir).groupBy("model", "regime").agg(*counts, F.count("*").alias("n"))
    ci = scores.wilson(F.col("t4"), F.col("n"))
    return h.select("model", "regime", "t0", "t1", "t2", "t3", "t4", "n", F.round(F.col("t4") / F.col("n"), 6).alias("rate"), F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


@registry.add(f"WITH {RESULTS} SELECT model, regime, tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model, regime), 6) AS share FROM results WHERE tier < 4 GROUP BY model, regime, tier")
def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the lower tiers among results that miss the top."""
    f = results(spark, sf_dir).filter("tier < 4").groupBy("model", "regime", "tier").agg(F.count("*").alias("n"))
    return f.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("model", "regime")), 6))


@registry.add(f"""
WITH {RESULTS}, c AS (SELECT model, regime, count(*) AS n, count(*) FILTER (WHERE tier = 4)::DOUBLE / count(*) AS p FROM results GROUP BY ALL), w AS (SELECT *, ({HIGH} - {LOW}) / 2 AS half FROM c)
SELECT a.model, round(100 * (b.p - a.p), 4) AS delta_pp, round(100 * (a.half + b.half), 4) AS noise_pp, abs(b.p - a.p) > a.half + b.half AS exceeds FROM w a JOIN w b ON a.model = b.model AND a.regime = 'single' AND b.regime = 'piecewise'
""")
def regime_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired regimes: difference in points against the sum of the intervals' halves."""
    c = results(spark, sf_dir).groupBy("model", "regime").agg(F.count("*").alias("n"), F.count_if(F.col("tier") == 4).alias("k"))
    ci = scores.wilson(F.col("k"), F.col("n"))
    c = c.select("model", "regime", (F.col("k") / F.col("n")).alias("p"), ((ci["high"] - ci["low"]) / 2).alias("half"))
    of = lambda regime, x: F.max(F.when(F.col("regime") == regime, F.col(x)))
    w = c.groupBy("model").agg(of("single", "p").alias("p1"), of("single", "half").alias("h1"), of("piecewise", "p").alias("p2"), of("piecewise", "half").alias("h2")).filter("p1 is not null and p2 is not null")
    return w.select("model", F.round(100 * (F.col("p2") - F.col("p1")), 4).alias("delta_pp"), F.round(100 * (F.col("h1") + F.col("h2")), 4).alias("noise_pp"), (F.abs(F.col("p2") - F.col("p1")) > F.col("h1") + F.col("h2")).alias("exceeds"))


@registry.add(f"""
WITH {RESULTS}, c AS (SELECT regime, model, count(*) AS n, count(*) FILTER (WHERE tier = 4)::DOUBLE / count(*) AS rate FROM results GROUP BY ALL)
SELECT regime, row_number() OVER (PARTITION BY regime ORDER BY rate DESC, n DESC, model) AS place, model, CASE WHEN model LIKE '1-%' THEN 'first' WHEN model LIKE '5-%' THEN 'last' ELSE 'other' END AS class, n, round(rate, 6) AS rate, printf('%.1f%%', 100 * rate) AS shown FROM c
""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import percent

    c = results(spark, sf_dir).groupBy("regime", "model").agg(F.count("*").alias("n"), (F.count_if(F.col("tier") == 4) / F.count("*")).alias("rate"))
    kind = F.when(F.col("model").startswith("1-"), "first").when(F.col("model").startswith("5-"), "last").otherwise("other")
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("rate"), F.desc("n"), "model"))
    return c.select("regime", place.alias("place"), "model", kind.alias("class"), "n", F.round("rate", 6).alias("rate"), percent(F.col("rate")).alias("shown"))


@registry.add("SELECT event_type, user_id % 5 AS batch, count(*) AS total, count(*) FILTER (WHERE value > 5) AS passing, grouping_id(event_type, user_id % 5)::BIGINT AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5))")
def grouping_sets_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two group-bys in one pass."""
    table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("batch"), "value").createOrReplaceTempView("events_by_batch")
    return spark.sql("SELECT event_type, batch, count(*) AS total, count_if(value > 5) AS passing, grouping_id(event_type, batch) AS level FROM events_by_batch GROUP BY GROUPING SETS ((event_type), (batch))")


@registry.add("SELECT l_returnflag, l_linestatus, round_even(avg(l_quantity), 3) AS quantity, round(avg(l_extendedprice), 3) AS price, round(avg(l_discount), 3) AS discount, round(avg(l_tax), 3) AS tax, count(*) AS n FROM lineitem GROUP BY ALL")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.bround(F.avg("l_quantity"), 3).alias("quantity"), F.round(F.avg("l_extendedprice"), 3).alias("price"), F.round(F.avg("l_discount"), 3).alias("discount"), F.round(F.avg("l_tax"), 3).alias("tax"), F.count("*").alias("n"))


@registry.add("""
SELECT c_mktsegment, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def pivot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined on differently named keys, then a two-key mean with one key turned into columns."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    p = j.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return p.select("c_mktsegment", *[F.round(c, 2).alias(c) for c in ("F", "O", "P")])


@registry.add("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderdate) AS days FROM orders")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"), F.countDistinct("o_orderdate").alias("days"))


@registry.add("SELECT lang, coalesce(CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'fine' END, 'untagged') AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    verdict = F.coalesce(F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "fine"), F.lit("untagged"))
    return d.groupBy("lang", verdict.alias("verdict")).agg(F.count("*").alias("n"))


DAYS = "days AS (SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 8) AS good, round(avg(value), 6) AS mean FROM events GROUP BY 1)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day: n, errors, good, mean."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 8).alias("good"), F.round(F.avg("value"), 6).alias("mean"))


def by_day() -> WindowSpec:
    """Windows over one row a day run in one task, whatever the number of events: a table of days is small."""
    return Window.partitionBy(F.lit(1)).orderBy("day")


@registry.add(f"WITH {DAYS} SELECT day, n, errors, good, round(good / n, 3) AS good_rate, round(errors / n, 3) AS error_rate, mean, round(max(good / n) OVER (ORDER BY day), 3) AS best_so_far FROM days")
def timeline_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    best = F.max(F.col("good") / F.col("n")).over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    return d.select("day", "n", "errors", "good", F.round(F.col("good") / F.col("n"), 3).alias("good_rate"), F.round(F.col("errors") / F.col("n"), 3).alias("error_rate"), "mean", F.round(best, 3).alias("best_so_far"))


@registry.add(f"""
WITH {DAYS}, w AS (SELECT *, sum(good) OVER w5 AS g5, sum(n) OVER w5 AS n5, avg(coalesce(good / nullif(errors, 0), 0)) OVER w50 AS ratios FROM days WINDOW w5 AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w50 AS (ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT day, round(g5 / n5, 6) AS rolling_rate, round(ratios, 6) AS mean_of_ratios, CASE WHEN g5 / n5 >= 0.8 THEN 5 WHEN g5 / n5 >= 0.6 THEN 4 WHEN g5 / n5 >= 0.4 THEN 3 ELSE 2 END AS cap FROM w
""")
def rolling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of sums over the last five rows and the difficulty cap it allows; mean of ratios (no value for a division by zero counts 0) over the last fifty."""
    w = by_day().rowsBetween(-4, 0)
    rate = F.sum("good").over(w) / F.sum("n").over(w)
    ratios = F.avg(F.coalesce(F.col("good") / F.nullif(F.col("errors"), F.lit(0)), F.lit(0.0))).over(by_day().rowsBetween(-49, 0))
    return days(spark, sf_dir).select("day", F.round(rate, 6).alias("rolling_rate"), F.round(ratios, 6).alias("mean_of_ratios"), scores.difficulty_cap(rate, F.lit(1.0)).alias("cap"))


@registry.add("""
WITH d AS (SELECT user_id, event_id, value, event_type, value < 3 AS low FROM events),
i AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM d),
s AS (SELECT *, CASE WHEN low THEN count(*) FILTER (WHERE low) OVER (PARTITION BY user_id, island ORDER BY event_id) ELSE 0 END AS streak,
  CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS change, count(*) OVER w5 >= 5 AND max(value) OVER w5 < 6 AS floor_breach FROM i WINDOW w5 AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
SELECT user_id, event_id, streak, streak % 4 AS streak_mod, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS repeats, floor_breach FROM r
""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of low values, the same modulo four, repeated types in a row, and five rows under a floor, per user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    s = ranking.streaks(e, ["user_id"], "event_id", F.col("value") < 3)
    s = s.withColumn("floor_breach", ranking.below_for(s, ["user_id"], "event_id", "value", 5, 6))
    return ranking.repeats(s, ["user_id"], "event_id", "event_type").select("user_id", "event_id", "streak", (F.col("streak") % 4).alias("streak_mod"), "repeats", "floor_breach")


RANKED = "SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, max(CASE WHEN value > 8 THEN 3 WHEN value > 5 THEN 2 ELSE 1 END) AS rank FROM events GROUP BY ALL"


def best_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("value") > 8, "gold").when(F.col("value") > 5, "silver").otherwise("bronze")
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max(scores.rank_of(tier)).alias("rank"))


@registry.add(f"WITH b AS ({RANKED}), l AS (SELECT *, lag(rank) OVER (PARTITION BY user_id ORDER BY day) AS before FROM b) SELECT user_id, day, before, rank, CASE WHEN rank > before THEN 'improved' WHEN rank < before THEN 'regressed' ELSE 'same' END AS change FROM l WHERE before IS NOT NULL")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best tier of each key by day against the day before; first ones are left out."""
    return ranking.deltas(best_by_day(spark, sf_dir), ["user_id"], "day", "rank").select("user_id", "day", "before", "rank", "change")


HALVES = f"b AS ({RANKED}), a1 AS (SELECT user_id, max(rank) AS rank FROM b WHERE day < '2024-01-16' GROUP BY user_id), a2 AS (SELECT user_id, max(rank) AS rank FROM b WHERE day >= '2024-01-16' GROUP BY user_id)"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = best_by_day(spark, sf_dir)
    cut = F.col("day") < "2024-01-16"
    of = lambda part, name: b.filter(part).groupBy("user_id").agg(F.max("rank").alias(name))
    return of(cut, "rank_a"), of(~cut, "rank_b")


@registry.add(f"WITH {HALVES} SELECT user_id, a1.rank AS rank_a, a2.rank AS rank_b, CASE WHEN a2.rank > a1.rank THEN 'gain' WHEN a2.rank < a1.rank THEN 'regression' ELSE 'same' END AS outcome FROM a1 JOIN a2 USING (user_id)")
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return a.join(b, "user_id").withColumn("outcome", F.when(F.col("rank_b") > F.col("rank_a"), "gain").when(F.col("rank_b") < F.col("rank_a"), "regression").otherwise("same"))


@registry.add(f"WITH {HALVES} SELECT user_id, coalesce(a2.rank, a1.rank) AS rank FROM a1 FULL JOIN a2 USING (user_id)")
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old state and new: the new one wins."""
    a, b = halves(spark, sf_dir)
    return a.join(b, "user_id", "full_outer").select("user_id", F.coalesce("rank_b", "rank_a").alias("rank"))


@registry.add(f"WITH {HALVES} SELECT user_id, rank, 'old' AS came FROM a1 WHERE NOT EXISTS (SELECT 1 FROM a2 WHERE a2.user_id = a1.user_id AND a2.rank > a1.rank) UNION ALL SELECT user_id, rank, 'new' FROM a2 WHERE NOT EXISTS (SELECT 1 FROM a1 WHERE a1.user_id = a2.user_id AND a1.rank >= a2.rank)")
def upsert_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return dedup.upsert(a.select("user_id", F.col("rank_a").alias("rank"), F.lit("old").alias("came")), b.select("user_id", F.col("rank_b").alias("rank"), F.lit("new").alias("came")), "user_id", "rank")


@registry.add("""
WITH d AS (SELECT event_id, user_id, value, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM events)
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id, era ORDER BY event_id), 4) AS accumulated FROM d
""")
def accumulate_until_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranking.since_reset(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", F.col("event_type") == "purchase")
    return e.select("event_id", "user_id", F.round("accumulated", 4).alias("accumulated"))


@registry.add("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NULL AS no_other FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k long, missing string")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["missing"].isNull().alias("no_other"))


SHAPED = "CASE WHEN a - b < -0.01 THEN greatest(0.0, 0.1 + (a - b)) WHEN a - b < 0.01 THEN 0.15 ELSE least(1.0, 0.2 + (a - b) * 0.6 + CASE WHEN b < 0.10 AND a >= 0.10 THEN 0.1 ELSE 0 END + CASE WHEN b < 0.40 AND a >= 0.40 THEN 0.1 ELSE 0 END + CASE WHEN a >= 1.0 THEN 0.1 ELSE 0 END) END"


@registry.add(f"""
WITH s AS (SELECT event_id, (event_id % 21)::DOUBLE / 20 AS b, ((event_id // 21) % 21)::DOUBLE / 20 AS a FROM events)
SELECT event_id, round({SHAPED}, 6) AS reward, CASE WHEN b < 0.10 THEN 'easy' WHEN b < 0.40 THEN 'medium' ELSE 'hard' END AS band, abs(a - b) >= 0.01 AS has_gap FROM s
""")
def reward_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = (F.col("event_id") % 21).cast("double") / 20, (F.floor(F.col("event_id") / 21) % 21).cast("double") / 20
    return table(spark, sf_dir, "events").select("event_id", F.round(scores.shaped_reward(b, a), 6).alias("reward"), scores.difficulty_band(b).alias("band"), (F.abs(a - b) >= 0.01).alias("has_gap"))


@registry.add(r"""
WITH t AS (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN 'so <answer>' || value || '</answer> it is 7' WHEN event_id % 3 = 1 THEN 'first 1, then ' || value ELSE 'nothing' END AS t FROM events),
x AS (SELECT *, replace(coalesce(nullif(regexp_extract(t, '<answer>\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*</answer>', 1), ''), list_last(regexp_extract_all(t, '-?[0-9][0-9,]*(?:\.[0-9]+)?'))), ',', '') AS found FROM t)
SELECT event_id, found, CASE WHEN found IS NULL THEN 0.0 WHEN abs(TRY_CAST(found AS DOUBLE) - value) < 1e-6 THEN 1.0 ELSE 0.1 END AS reward, nullif(regexp_extract(t, '(-?[0-9]+)', 1), '') AS first FROM x
""")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value").cast("string")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so <answer>"), v, F.lit("</answer> it is 7"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("first 1, then "), v)).otherwise("nothing")
    x = table(spark, sf_dir, "events").select("event_id", "value", t.alias("t"))
    found = scores.answer(F.col("t"))
    return x.select("event_id", found.alias("found"), scores.answer_reward(found, v).alias("reward"), scores.first_number(F.col("t")).alias("first"))


W = scores.COMPONENT_WEIGHTS


@registry.add("SELECT event_id, round(" + " + ".join(f"CASE WHEN (event_id >> {i}) % 2 = 1 THEN {w} ELSE 0 END" for i, w in enumerate(W.values())) + ", 4) AS credit, CASE WHEN event_id % 2 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 3 ELSE 4 END AS ladder, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE CASE WHEN user_id % 8 = 0 THEN 0.35 WHEN user_id % 8 <= 2 THEN 0.25 WHEN user_id % 8 <= 5 THEN 0.15 ELSE 0.10 END END AS reward, hour(ts) >= 22 OR hour(ts) < 6 AS night FROM events")
def credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    bits = {k: F.shiftright(e, i) % 2 == 1 for i, k in enumerate(W)}
    tier = F.when(e % 3 == 0, "gold").when(e % 3 == 1, "silver").otherwise("bronze")
    return table(spark, sf_dir, "events").select("event_id", scores.component_credit(**bits).alias("credit"), scores.ladder(e % 2 != 0, e % 3 != 0, e % 5 != 0, e % 7 != 0).alias("ladder"), scores.tier_reward(tier, F.col("user_id") % 8).alias("reward"), scores.night(F.col("ts")).alias("night"))


@registry.add("""
SELECT o_orderkey, o_custkey, p.c_name AS old_name, coalesce(p.c_name, 'none') AS name, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) p ON o_custkey = p.c_custkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def join_enrich_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join with defaults after an anti join against a holdout."""
    c = table(spark, sf_dir, "customer")
    holdout = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    p = c.filter("c_acctbal > 0").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").join(holdout, "o_custkey", "left_anti").join(p, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", "o_custkey", F.col("c_name").alias("old_name"), F.coalesce("c_name", F.lit("none")).alias("name"), F.col("c_custkey").isNotNull().alias("known"))


@registry.add("SELECT n_name, r_name, count(c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey GROUP BY ALL")
def two_hop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.lit(1).alias("suppliers"))
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


@registry.add("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_partkey = lineitem.l_partkey AND d.l_suppkey = lineitem.l_suppkey AND d.l_returnflag = 'A')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that isn't done: an anti join on several keys."""
    li = table(spark, sf_dir, "lineitem")
    done = li.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct()
    return li.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct().join(done, ["l_partkey", "l_suppkey"], "left_anti")


@registry.add("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09) AS discounted FROM supplier")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows split by membership: both halves, told apart."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    held = table(spark, sf_dir, "lineitem").filter("l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return s.join(held, "s_suppkey", "left_semi").withColumn("discounted", F.lit(True)).union(s.join(held, "s_suppkey", "left_anti").withColumn("discounted", F.lit(False)))


@registry.add("WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem), c AS (SELECT count(*) AS covered FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM f)) SELECT covered, (SELECT count(*) FROM orders) - covered AS missing FROM c")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a suite that results cover, and those missing."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(seen, "o_orderkey", "left").agg(F.count("hit").alias("covered"), F.count_if(F.col("hit").isNull()).alias("missing"))


@registry.add("SELECT c_mktsegment, max(rate) AS best, max_by(n_name, rate) AS best_nation FROM (SELECT c_mktsegment, n_name, round(avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0 END), 6) + n_nationkey * 1e-9 AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name, n_nationkey) GROUP BY c_mktsegment")
def best_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest of the rates of smaller groups, and whose it is."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rate = F.round(F.avg(F.when(F.col("c_acctbal") > 5000, 1.0).otherwise(0.0)), 6) + F.col("n_nationkey") * F.lit(1e-9)
    r = j.groupBy("c_mktsegment", "n_name", "n_nationkey").agg(rate.alias("rate"))
    return r.groupBy("c_mktsegment").agg(F.max("rate").alias("best"), F.max_by("n_name", "rate").alias("best_nation"))


E = "CASE event_type WHEN 'error' THEN 'syntax' WHEN 'click' THEN 'timeout' WHEN 'view' THEN 'deadlock' ELSE 'other' END"


@registry.add("SELECT user_id % 10 AS cycle, " + ", ".join(f"count(*) FILTER (WHERE {E} = '{c}') AS {c}" for c in scores.ERROR_CLASSES) + " FROM events GROUP BY 1")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a fixed list of classes, zero where there is none."""
    kind = F.when(F.col("event_type") == "error", "syntax").when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "view", "deadlock").otherwise("other")
    p = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("cycle"), kind.alias("kind")).groupBy("cycle").pivot("kind", list(scores.ERROR_CLASSES)).count()
    return p.fillna(0)


@registry.add("SELECT day, errors > 100 AS many_errors, good = 0 AS no_good, coalesce(n < 0.8 * lag(n) OVER (ORDER BY day), false) AS dropped, coalesce(mean - lag(mean) OVER (ORDER BY day) >= 0, true) AS promote FROM (SELECT * FROM (SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 8) AS good, round(avg(value), 6) AS mean FROM events GROUP BY 1))")
def alerts_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notable-event rules and promotion gates, one column each."""
    d = days(spark, sf_dir)
    return d.select("day", (F.col("errors") > 100).alias("many_errors"), (F.col("good") == 0).alias("no_good"), F.coalesce(F.col("n") < 0.8 * F.lag("n").over(by_day()), F.lit(False)).alias("dropped"), F.coalesce(F.col("mean") - F.lag("mean").over(by_day()) >= 0, F.lit(True)).alias("promote"))


@registry.add("SELECT * EXCLUDE (rn) FROM (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 20")
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dearest orders (a top-k report)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
