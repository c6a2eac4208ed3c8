"""Queries over a loop's results. Events stand for results: a user for a prompt, ten days for a cycle, and what an event holds for its verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import training
from .registry import Registry, table

registry = Registry()

K = "CAST(json_extract_string(props, '$.k') AS INT)"
RESULTS = f"""
WITH k AS (SELECT *, {K} AS k FROM events), results AS (
  SELECT (day(ts) - 1) // 10 AS cycle, user_id AS prompt_id, event_id AS position, 'prompt ' || user_id AS prompt_text, event_type || ' ' || event_id || repeat(' x', k) AS spec,
    CASE WHEN k < 4 THEN 'gold' WHEN k < 40 THEN 'silver' ELSE 'bronze' END AS tier, k = 1 OR k = 20 AS is_diamond, event_id % 31 = 0 AS timed_out, event_type <> 'error' AS parsed,
    CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['Error: at ' || event_id] ELSE ['Error: no ' || k, 'Invariant Inv is violated'] END AS violations,
    CASE k % 3 WHEN 2 THEN 'Invariant Inv is violated' ELSE '' END AS log,
    CASE WHEN k < 3 THEN event_type || ' broken' END AS repair_from, ['E' || k, 'TLC_TIMEOUT', 'F'] AS repair_violations, CASE WHEN event_id % 2 = 0 THEN 'sany' ELSE 'tlc' END AS repair_type
  FROM k
)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results that RESULTS states."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, event_id, kind = F.col("k"), F.col("event_id"), F.col("event_type")
    faults = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(line("Error: at ", event_id))).otherwise(F.array(line("Error: no ", k), F.lit("Invariant Inv is violated")))
    return e.select(
        F.floor((F.dayofmonth("ts") - 1) / 10).alias("cycle"), F.col("user_id").alias("prompt_id"), event_id.alias("position"), line("prompt ", F.col("user_id")).alias("prompt_text"), F.concat(line(kind, " ", event_id), F.repeat(F.lit(" x"), k)).alias("spec"),
        F.when(k < 4, "gold").when(k < 40, "silver").otherwise("bronze").alias("tier"), ((k == 1) | (k == 20)).alias("is_diamond"), (event_id % 31 == 0).alias("timed_out"), (kind != "error").alias("parsed"),
        faults.alias("violations"), F.when(k % 3 == 2, "Invariant Inv is violated").otherwise("").alias("log"),
        F.when(k < 3, line(kind, " broken")).alias("repair_from"), F.array(line("E", k), F.lit("TLC_TIMEOUT"), F.lit("F")).alias("repair_violations"), F.when(event_id % 2 == 0, "sany").otherwise("tlc").alias("repair_type"),
    )


SQL = f"""{RESULTS}, ranked AS (
  SELECT *, CASE tier WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 ELSE 1 END + is_diamond::INT AS rank, row_number() OVER (PARTITION BY cycle, prompt_id ORDER BY CASE tier WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 ELSE 1 END + is_diamond::INT DESC, position) AS place,
    count(*) OVER (PARTITION BY cycle, prompt_id) AS n, bool_or(tier = 'gold') OVER (PARTITION BY cycle, prompt_id) AS any_gold,
    array_to_string(list_concat(CASE WHEN log <> '' THEN ['INVARIANT VIOLATION: Inv was violated.'] ELSE [] END, list_transform(list_filter(violations, lambda v: v LIKE 'Error%'), lambda v: 'TLC ERROR: ' || v)), chr(10)) AS told
  FROM results
), best AS (
  SELECT *, timed_out AND tier <> 'gold' AS skipped FROM ranked WHERE place = 1
), last AS (
  SELECT * FROM ranked WHERE place = n
), fault AS (
  SELECT * FROM ranked WHERE tier <> 'gold' AND (len(violations) > 0 OR NOT parsed) QUALIFY row_number() OVER (PARTITION BY cycle, prompt_id ORDER BY place) = 1
), open AS (
  SELECT * FROM ranked WHERE tier = 'silver' AND len(violations) > 0 OR tier = 'bronze' AND NOT parsed QUALIFY row_number() OVER (PARTITION BY cycle, prompt_id ORDER BY place) = 1
), cache AS (
  SELECT prompt_id, cycle AS gold_cycle, spec AS gold FROM results WHERE tier = 'gold' QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY cycle, position DESC) = 1
), rows AS (
  SELECT cycle, prompt_id, 'sft' AS kind, CASE WHEN is_diamond THEN 'diamond' ELSE 'gold' END AS tier, prompt_id::VARCHAR AS row_id, '{training.WRITE}' || prompt_text AS asked, spec AS answer, NULL AS rejected, NULL AS rejected_tier, NULL AS feedback FROM best WHERE NOT skipped AND (is_diamond OR tier = 'gold')
  UNION ALL SELECT b.cycle, b.prompt_id, 'dpo', 'diamond', b.prompt_id::VARCHAR, '{training.WRITE}' || b.prompt_text, b.spec, l.spec, l.tier, CASE WHEN len(l.violations) > 0 THEN array_to_string(l.violations, chr(10)) WHEN NOT l.parsed THEN '{training.UNPARSED}' WHEN l.tier = 'gold' THEN '{training.VACUOUS}' ELSE 'TLC failed (' || l.tier || ') vs diamond' END
    FROM best b JOIN last l USING (cycle, prompt_id) WHERE NOT b.skipped AND b.is_diamond AND NOT l.is_diamond AND l.rank < b.rank
  UNION ALL SELECT b.cycle, b.prompt_id, 'sft', 'bugfix', b.prompt_id || '_bugfix', '{training.MODEL_ERRORS}' || CASE WHEN len(f.violations) > 0 THEN f.told ELSE 'SANY parse errors' END || chr(10) || chr(10) || 'Buggy spec:' || chr(10) || f.spec || chr(10) || chr(10) || 'Fix ALL errors and produce a correct spec.', b.spec, NULL, NULL, NULL
    FROM best b JOIN fault f USING (cycle, prompt_id) WHERE b.tier = 'gold'
  UNION ALL SELECT o.cycle, o.prompt_id, 'sft', CASE o.tier WHEN 'silver' THEN 'cross_cycle_bugfix' ELSE 'cross_cycle_syntax' END, o.prompt_id || CASE o.tier WHEN 'silver' THEN '_xcycle' ELSE '_xcycle_syn' END,
    CASE o.tier WHEN 'silver' THEN '{training.MODEL_ERRORS}' || o.told || chr(10) || chr(10) || 'Buggy spec:' || chr(10) || o.spec || chr(10) || chr(10) || 'Fix ALL errors and produce a correct spec.' ELSE '{training.WRITE}' || o.prompt_text END, gold, NULL, NULL, NULL
    FROM open o JOIN cache USING (prompt_id) WHERE NOT any_gold AND gold_cycle < cycle
  UNION ALL SELECT r.cycle, r.prompt_id, unnest(['sft', 'dpo']), CASE r.repair_type WHEN 'sany' THEN 'sany_repair' ELSE 'rlvr_repair' END, unnest([r.prompt_id || CASE r.repair_type WHEN 'sany' THEN '_sany_repair' ELSE '_rlvr' END, r.prompt_id::VARCHAR]),
    unnest([CASE r.repair_type WHEN 'sany' THEN '{training.SYNTAX_ERRORS}' ELSE '{training.CHECKER_ERRORS}' END || r.repair_violations[1] || chr(10) || 'F' || chr(10) || chr(10) || 'Broken spec:' || chr(10) || r.repair_from || CASE r.repair_type WHEN 'sany' THEN chr(10) || chr(10) || 'Fix ALL syntax errors and produce a correct spec.' ELSE '' END,
      'Fix this TLA+ spec. ' || CASE r.repair_type WHEN 'sany' THEN 'SANY parse errors:' ELSE 'TLC errors:' END || chr(10) || r.repair_violations[1] || chr(10) || 'F' || chr(10) || chr(10) || 'Broken spec:' || chr(10) || r.repair_from]),
    r.spec, unnest([NULL, r.repair_from]), unnest([NULL, CASE r.repair_type WHEN 'sany' THEN 'bronze' ELSE 'silver' END]), unnest([NULL, r.repair_violations[1] || chr(10) || 'F'])
    FROM results r JOIN best b USING (cycle, prompt_id) WHERE r.tier = 'gold' AND r.repair_from IS NOT NULL AND NOT b.skipped
)"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.training_rows(results(spark, sf_dir))
    return rows.withColumns({"asked": F.coalesce("prompt", F.get("messages", F.lit(1))["content"]), "answer": F.coalesce("chosen", F.get("messages", F.lit(3))["content"])})


@registry.add(f"{SQL} SELECT cycle, prompt_id, kind, tier, row_id, asked, answer, rejected, rejected_tier, feedback FROM rows")
def loop_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five kinds of rows of every cycle, with all texts."""
    return built(spark, sf_dir).select("cycle", "prompt_id", "kind", "tier", "row_id", "asked", "answer", "rejected", "rejected_tier", "feedback")


@registry.add(f"{SQL}, firsts AS (SELECT cycle, row_id, tier, substr(sha256(answer), 1, 16) AS content_hash FROM rows WHERE kind = 'sft' AND substr(sha256(answer), 1, 16) NOT IN (SELECT substr(sha256(answer), 1, 16) FROM rows WHERE kind = 'sft' AND cycle = 0)) SELECT DISTINCT ON (content_hash) cycle, row_id, tier, content_hash FROM firsts ORDER BY content_hash, cycle, row_id, tier")
def loop_new_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of later cycles whose final text neither the first cycle's nor an earlier one has."""
    rows = built(spark, sf_dir)
    return training.new_examples(rows.filter("cycle > 0"), rows.filter("cycle = 0 and kind = 'sft'")).select("cycle", "row_id", "tier", "content_hash")


@registry.add(f"{RESULTS} SELECT prompt_id, cycle, spec FROM results WHERE tier = 'gold' QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY cycle, position DESC) = 1")
def loop_gold_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after all cycles, each inserting what is absent."""
    rows = results(spark, sf_dir)
    cache = training.gold_cache(rows.filter("cycle = 0"))
    for cycle in (1, 2):
        cache = training.insert_if_absent(cache, rows.filter(F.col("cycle") == cycle))
    return cache


@registry.add(f"""{SQL}, own AS (SELECT asked AS prompt, answer AS chosen, rejected, CASE WHEN tier = 'diamond' THEN 'diamond' ELSE 'gold' END AS chosen_tier, rejected_tier, cycle FROM rows WHERE kind = 'dpo'),
old AS (SELECT prompt, chosen, rejected, 'bronze' AS chosen_tier, rejected_tier FROM own WHERE cycle = 0 AND chosen_tier = 'gold' QUALIFY row_number() OVER (PARTITION BY substr(prompt, 1, 200) ORDER BY prompt, chosen, rejected) = 1),
fresh AS (SELECT prompt, chosen, rejected, chosen_tier, rejected_tier FROM own WHERE cycle > 0 AND chosen_tier = 'gold' QUALIFY row_number() OVER (PARTITION BY substr(prompt, 1, 200) ORDER BY prompt, chosen, rejected) = 1)
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE substr(prompt, 1, 200) NOT IN (SELECT substr(prompt, 1, 200) FROM fresh)""")
def loop_merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the first cycle, there as bronze, and later gold ones that replace them by the start of the prompt."""
    rows = built(spark, sf_dir).filter("kind = 'dpo'")
    old = training.merged_pairs(rows.limit(0), rows.filter("cycle = 0")).withColumn("chosen_tier", F.lit("bronze"))
    return training.merged_pairs(old, rows.filter("cycle > 0"))


@registry.add(f"""{RESULTS}, latest AS (SELECT prompt_id, spec FROM results QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY cycle DESC, position DESC) = 1),
cache AS (SELECT prompt_id, spec FROM results WHERE tier = 'gold' QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY cycle, position DESC) = 1)
SELECT prompt_id, '{training.WRITE}prompt ' || prompt_id AS prompt, cache.spec AS chosen, latest.spec AS rejected FROM cache JOIN latest USING (prompt_id) WHERE length(latest.spec) >= 50""")
def gold_against_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold texts with the latest result of their prompt, if long enough, as the rejected side."""
    rows = results(spark, sf_dir)
    gold = training.gold_cache(rows).withColumn("prompt_text", F.concat(F.lit("prompt "), F.col("prompt_id").cast("string")))
    return training.gold_against_latest(gold, rows).select("prompt_id", "prompt", "chosen", "rejected")
