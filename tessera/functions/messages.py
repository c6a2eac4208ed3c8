"""Chat messages, array<struct<role, channel, content>>, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def _content(messages: Column, at: int) -> Column:
    return F.try_element_at(messages, F.lit(at))["content"]


def first_final(messages: Column) -> Column:
    """The first assistant message of the final channel, or the empty text."""
    final = F.filter(messages, lambda m: (m["role"] == "assistant") & (m["channel"] == "final"))
    return F.coalesce(_content(final, 1), F.lit(""))


def final_or_last(messages: Column) -> Column:
    """The first final message, else the last of the assistant."""
    final = F.filter(messages, lambda m: (m["role"] == "assistant") & (m["channel"] == "final"))
    return F.coalesce(_content(final, 1), _content(_role(messages, "assistant"), -1))


def first_with(messages: Column, marker: str) -> Column:
    found = F.filter(messages, lambda m: (m["role"] == "assistant") & F.contains(m["content"], F.lit(marker)))
    return F.coalesce(_content(found, 1), F.lit(""))


def first_user(messages: Column) -> Column:
    return F.coalesce(_content(_role(messages, "user"), 1), F.lit(""))


def last_user(messages: Column) -> Column:
    return _content(_role(messages, "user"), -1)


def last_final(messages: Column) -> Column:
    return _content(F.filter(messages, lambda m: (m["role"] == "assistant") & (m["channel"] == "final")), -1)


def without_prefix(text: Column, prefix: str, often: bool = False) -> Column:
    """Without a leading task prefix (a pattern), whatever its case; often: as many times as it comes."""
    return F.regexp_replace(text, rf"(?i)^(?:{prefix}\s*)" + ("+" if often else ""), "")


def standard_roles(messages: Column) -> Column:
    """developer becomes system; neighbouring parts of the assistant become one message, analysis parts wrapped in a tag."""
    part = lambda m: F.when((m["role"] == "assistant") & (m["channel"] == "analysis"), F.concat(F.lit("<analysis>\n"), m["content"], F.lit("\n</analysis>"))).otherwise(m["content"])
    plain = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "developer", "system").otherwise(m["role"]).alias("role"), part(m).alias("content")))

    def add(out: Column, m: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = F.coalesce((m["role"] == "assistant") & (last["role"] == "assistant"), F.lit(False))
        merged = F.struct(m["role"].alias("role"), F.concat(last["content"], F.lit("\n"), m["content"]).alias("content"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(m)))

    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.aggregate(plain, empty, add)


def with_analysis(messages: Column, text: Column) -> Column:
    """The first analysis message gets the new text; the others stay."""
    at = F.array_position(F.transform(messages, lambda m: F.coalesce(m["channel"] == "analysis", F.lit(False))), F.lit(True))
    return F.transform(messages, lambda m, i: F.when(i == at - 1, F.struct(m["role"].alias("role"), m["channel"].alias("channel"), F.coalesce(text, m["content"]).alias("content"))).otherwise(m))


def is_repair_request(messages: Column) -> Column:
    user = F.lower(first_user(messages))
    return F.contains(user, F.lit("syntax errors")) | F.contains(user, F.lit("sany errors")) | F.contains(user, F.lit("fix the spec"))


def message(role: str, content: Column, channel: str | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(channel).cast("string").alias("channel"), content.alias("content"))
