"""Queries over conversations: message selection, conversion, labelled rows, accumulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import messages, rewards
from ..operators import ranking
from .registry import Registry, table

registry = Registry()


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in order of turn. Assistant turns at odd places are analysis, the others final; a conversation is one row."""
    channel = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 4 == 1, "analysis").otherwise("final"))
    turn = F.struct("turn", F.col("role"), channel.alias("channel"), F.col("text").alias("content"))
    ordered = F.array_sort(F.collect_list(turn))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["channel"].alias("channel"), m["content"].alias("content"))).alias("messages"))


ROWS = "m AS (SELECT *, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'analysis' ELSE 'final' END END AS channel FROM conversations)"


@registry.add(f"""
WITH {ROWS}
SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant' AND channel = 'final'), '') AS first_final,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant' AND channel = 'final'), arg_max(text, turn) FILTER (WHERE role = 'assistant')) AS final_or_last,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS first_user, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user,
  arg_max(text, turn) FILTER (WHERE role = 'assistant' AND channel = 'final') AS last_final,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant' AND contains(text, 'the')), '') AS first_with,
  regexp_replace(coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), ''), '^(?:the\\s*)+', '', 'i') AS without_prefix
FROM m GROUP BY conv_id
""")
def chat_final_or_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return chats(spark, sf_dir).select("conv_id", messages.first_final(m).alias("first_final"), messages.final_or_last(m).alias("final_or_last"), messages.first_user(m).alias("first_user"), messages.last_user(m).alias("last_user"), messages.last_final(m).alias("last_final"), messages.first_with(m, "the").alias("first_with"), messages.without_prefix(messages.first_user(m), "the", often=True).alias("without_prefix"))


@registry.add(f"""
WITH {ROWS}, p AS (SELECT conv_id, turn, CASE WHEN role = 'developer' THEN 'system' ELSE role END AS role, CASE WHEN channel = 'analysis' THEN '<analysis>' || chr(10) || text || chr(10) || '</analysis>' ELSE text END AS content FROM m),
c AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN 0 ELSE 1 END AS new FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM c)
SELECT conv_id, (grp - 1)::INT AS place, any_value(role) AS role, string_agg(content, chr(10) ORDER BY turn) AS content FROM g GROUP BY conv_id, grp
""")
def chat_to_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chats(spark, sf_dir).select("conv_id", F.posexplode(messages.standard_roles(F.col("messages"))).alias("place", "m"))
    return rows.select("conv_id", "place", "m.role", "m.content")


@registry.add("""
WITH p AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS prompt, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS chosen, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS rejected, count(*) AS n FROM conversations GROUP BY conv_id),
f AS (SELECT *, CASE WHEN n >= 3 THEN 'gold' ELSE 'silver' END AS tier FROM p WHERE prompt IS NOT NULL AND chosen IS NOT NULL AND length(prompt) + greatest(length(chosen), length(rejected)) <= 4000)
SELECT conv_id, prompt, chosen AS completion, true AS label FROM f WHERE tier = 'gold' UNION ALL SELECT conv_id, prompt, rejected, false FROM f
""")
def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under a character budget as positive rows (of gold tier only) and negative rows."""
    role = lambda r: F.col("role") == r
    text = lambda r: F.when(role(r), F.col("text"))
    turn = lambda r: F.when(role(r), F.col("turn"))
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(text("user"), turn("user")).alias("prompt"), F.max_by(text("assistant"), turn("assistant")).alias("chosen"), F.min_by(text("assistant"), turn("assistant")).alias("rejected"), F.count("*").alias("n"))
    p = p.filter(F.length("prompt") + F.greatest(F.length("chosen"), F.length("rejected")) <= 4000)
    positive = F.when(F.col("n") >= 3, F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")))
    negative = F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label"))
    return p.select("conv_id", "prompt", F.explode(F.array_compact(F.array(positive, negative))).alias("x")).select("conv_id", "prompt", "x.completion", "x.label")


@registry.add("SELECT conv_id, turn, role, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prefix FROM conversations")
def stage_prefix_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.earlier_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "role", "prefix")


@registry.add(f"""
WITH {ROWS}, f AS (SELECT conv_id, min(turn) FILTER (WHERE channel = 'analysis') AS first_turn FROM m GROUP BY conv_id)
SELECT m.conv_id, (row_number() OVER (PARTITION BY m.conv_id ORDER BY turn) - 1)::INT AS place, CASE WHEN turn = first_turn THEN 'reasoning ' || m.conv_id ELSE text END AS content FROM m JOIN f USING (conv_id)
""")
def merge_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first analysis message of a conversation takes its reasoning from another table."""
    reasons = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("reason", F.concat(F.lit("reasoning "), F.col("conv_id").cast("string")))
    merged = chats(spark, sf_dir).join(reasons, "conv_id", "left").select("conv_id", F.posexplode(messages.with_analysis(F.col("messages"), F.col("reason"))).alias("place", "m"))
    return merged.select("conv_id", "place", F.col("m.content").alias("content"))


@registry.add("SELECT conv_id, turn, lead(turn) OVER w AS next_turn, length(text) AS before_len, length(lead(text) OVER w) AS after_len FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL")
def step_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of a trajectory with the next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.length("text").alias("before_len"), F.length(F.lead("text").over(w)).alias("after_len")).filter("next_turn is not null")


@registry.add("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, coalesce(max(CASE WHEN role = 'assistant' AND length(text) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM conversations)
SELECT conv_id, turn, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS best FROM t WHERE stopped = 0) WHERE best = 1
""")
def best_until_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the attempts up to the first success, the best."""
    n = F.length("text")
    return ranking.until_first(table(spark, sf_dir, "conversations"), "conv_id", "turn", (F.col("role") == "assistant") & (n > 200), [n]).select("conv_id", "turn", n.alias("n"))


@registry.add("""
WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations),
w AS (SELECT conv_id, turn, text, string_split(text, ' ') AS ws, string_split(coalesce(prompt, ''), ' ') AS known FROM t WHERE role = 'assistant'),
s AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE len(list_filter(ws, lambda x: NOT list_contains(known, x)))::DOUBLE / len(ws) END AS share FROM w)
SELECT conv_id, turn, round(CASE WHEN trim(text) = '' THEN 0 ELSE least(1.0, share + CASE WHEN share > 0.75 THEN 0.1 ELSE 0 END) END, 6) AS reward FROM s
""")
def rewarded_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of assistant turns against the turn before, the completions as texts or as lists of messages."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("prompt", F.lag("text").over(w)).filter("role = 'assistant'")
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(*[F.struct(F.lit("assistant").alias("role"), c.alias("content")) for c in (F.substring("text", F.lit(1), half), F.col("text").substr(half + 1, F.length("text")))])
    shape = F.when(F.col("turn") % 4 == 1, F.to_json(parts)).otherwise(F.to_json(F.struct("text")))
    variant = F.when(F.col("turn") % 4 == 1, F.parse_json(shape)).otherwise(F.try_variant_get(F.parse_json(shape), "$.text", "variant"))
    text_ = rewards.completion_text(variant)
    return turns.select("conv_id", "turn", F.round(rewards.reward(rewards.shaped, F.col("prompt"), text_, before=F.lit(0.75)), 6).alias("reward"))
