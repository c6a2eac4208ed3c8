"""Reward functions over batches of completions.

A reward function has one signature, (prompts, completions, columns) -> list of floats, over plain
Python lists of a batch. reward() makes it a Column: an iterator UDF over Arrow batches, so that what
is costly to set up is set up once a task. Completions may be texts or lists of messages;
completion_text() reads either from a Variant.

A null completion is the empty text. A blank completion, and one whose grading fails, has reward 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Reward = Callable[[list, list, dict], list]


def completion_text(completion: Column) -> Column:
    """The text of a Variant: a string as it is, or the contents of a list of messages, joined."""
    messages = F.try_variant_get(completion, "$", "array<struct<role string, content string>>")
    joined = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "")
    text = F.try_variant_get(completion, "$", "string")
    kind = F.schema_of_variant(completion)
    return F.coalesce(F.when(kind.startswith("ARRAY"), joined).otherwise(text), F.lit(""))


def one_by_one(grade: Callable[[str, str], float]) -> Reward:
    """A reward function out of one that grades a single (prompt, completion)."""

    def each(prompts: list, completions: list, columns: dict) -> list:
        out = []
        for prompt, completion in zip(prompts, completions, strict=True):
            try:
                out.append(float(grade(prompt, completion)) if completion.strip() else 0.0)
            except Exception:  # a grader may fail on any text; such a text earns nothing
                out.append(0.0)
        return out

    return each


def reward(function: Reward, prompt: Column, completion: Column, **columns: Column) -> Column:
    """The function's reward of each row. prompt and completion are texts; columns go along by name."""
    names = list(columns)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for prompts, completions, *rest in batches:
            got = function(prompts.fillna("").tolist(), completions.fillna("").tolist(), {k: c.tolist() for k, c in zip(names, rest, strict=True)})
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} rewards for {len(prompts)} completions")
            yield pd.Series(got, dtype="float64")

    return run(prompt, completion, *columns.values())


def shaped(prompts: list, completions: list, columns: dict) -> list:
    """Share of words that are new against the prompt, and 0.1 more where it beats `before`; 1 at most."""
    out = []
    for prompt, completion, before in zip(prompts, completions, columns["before"], strict=True):
        words = completion.split(" ")
        known = set(prompt.split(" "))
        share = sum(w not in known for w in words) / len(words) if completion.strip() else 0.0
        out.append(min(1.0, share + (0.1 if share > before else 0.0)) if completion.strip() else 0.0)
    return out
