"""Corpus records as Column expressions: descriptions, prompts, markdown, JSON found in prose, coercion to a schema."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scores import known_or_other

TECHNICAL = T.StructType([T.StructField("overview", T.StringType()), T.StructField("variables", T.ArrayType(T.StringType())), T.StructField("actions", T.ArrayType(T.StringType())), T.StructField("invariants", T.ArrayType(T.StringType()))])
DESCRIPTION = T.StructType([T.StructField("narrative", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("difficulty", T.IntegerType()), T.StructField("technical", TECHNICAL)])


def composed(title: Column, authors: Column, comment: Column) -> Column:
    """struct(text, confidence, provenance): what is known, most telling first. Confidence is high with a title and a comment, medium with one, else low."""
    has = lambda c: F.length(F.coalesce(F.trim(c), F.lit(""))) > 0
    text = F.concat_ws("\n", F.when(has(title), F.concat(title, F.lit("."))), F.when(has(authors), F.concat(F.lit("By "), authors, F.lit("."))), F.when(has(comment), comment))
    confidence = F.when(has(title) & has(comment), "high").when(has(title) | has(comment), "medium").otherwise("low")
    return F.struct(text.alias("text"), confidence.alias("confidence"), F.array_compact(F.array(F.when(has(title), "index"), F.when(has(authors), "manifest"), F.when(has(comment), "comment"))).alias("provenance"))


def condensed(narrative: Column, actions: Column, init: Column, next_: Column, caps: tuple[int, int, int, int] = (1200, 8, 1200, 800)) -> Column:
    """A nested description as markdown of bounded size; empty parts are left out."""
    part = lambda head, body: F.when(F.length(F.coalesce(body, F.lit(""))) > 0, F.concat(F.lit(f"## {head}\n"), body))
    listed = F.array_join(F.transform(F.slice(F.coalesce(actions, F.array().cast("array<string>")), 1, caps[1]), lambda a: F.concat(F.lit("- "), a)), "\n")
    return F.concat_ws("\n", part("Summary", F.substring(narrative, 1, caps[0])), part("Actions", listed), part("Next", F.substring(next_, 1, caps[2])), part("Init", F.substring(init, 1, caps[3])))


def plan_markdown(module: Column, variables: Column, actions: Column) -> Column:
    """actions: array<struct<name, guard, effect>>."""
    rows = F.array_join(F.transform(actions, lambda a: F.concat(F.lit("- **"), a["name"], F.lit("**: when "), a["guard"], F.lit(" then "), a["effect"])), "\n")
    return F.concat(F.lit("# "), module, F.lit("\nVariables: "), F.array_join(variables, ", "), F.lit("\n"), rows)


def repair_prompt(id_: Column, task: Column, broken: Column, errors: Column) -> Column:
    """A prompt that carries its id in a comment."""
    return F.format_string("<!-- repair_id=%s -->\n%s\n\nBroken:\n%s\n\nErrors:\n%s", id_, task, broken, errors)


def repair_id(prompt: Column) -> Column:
    return F.nullif(F.regexp_extract(prompt, r"<!-- repair_id=(\S+) -->", 1), F.lit(""))


@F.pandas_udf(T.StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first object in a text that can be decoded, whatever stands around it; null if there is none. Nested braces aren't regular."""
    decoder = json.JSONDecoder()

    def find(t: str) -> str | None:
        at = t.find("{")
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(t, at)
                return json.dumps(found, ensure_ascii=False)
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return text.map(lambda t: find(t or ""))


def fenced_json(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))


def coerced(text: Column) -> Column:
    """A description of the full shape: missing texts empty, missing lists empty, domain known or other, difficulty 1 to 5."""
    d = F.from_json(text, DESCRIPTION)
    t = d["technical"]
    list_ = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    technical = F.struct(F.coalesce(t["overview"], F.lit("")).alias("overview"), *[list_(t[c]).alias(c) for c in ("variables", "actions", "invariants")])
    return F.struct(F.coalesce(d["narrative"], F.lit("")).alias("narrative"), known_or_other(F.coalesce(d["domain"], F.lit(""))).alias("domain"), F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(d["difficulty"], F.lit(3)))).alias("difficulty"), technical.alias("technical"))


def description_errors(d: Column) -> Column:
    """Problems of a coerced description, in order."""
    return F.array_compact(F.array(F.when(F.length(d["narrative"]) < 20, "narrative too short"), F.when(F.size(d["technical"]["actions"]) == 0, "no actions"), F.when(F.size(d["technical"]["variables"]) == 0, "no variables"), F.when(d["domain"] == "other", "domain unknown")))


def record_errors(id_: Column, content: Column, source: Column) -> Column:
    from .text import content_id

    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(F.array(F.when(empty(id_), "id missing"), F.when(empty(content), "content missing"), F.when(empty(source), "source missing"), F.when(~empty(content) & (id_ != content_id(content)), "id mismatch")))
