"""Hooks for external checkers: a checker is a function of a list of texts, called once a batch on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A checker takes texts and returns a dict each: valid, tier, errors, log.
Checker = Callable[[list[str]], list[dict]]


def structural(df: DataFrame, text: str) -> DataFrame:
    """The default without a tool: a header and a terminator. It claims validity of form only, and no tier."""
    t = F.col(text)
    return df.withColumn("valid", t.rlike(r"----\s*MODULE\s+\w+\s*----") & F.contains(t, F.lit("====")))


def checked(df: DataFrame, text: str, checker: Checker, id_: str) -> DataFrame:
    """id, valid, tier, errors, log by an external tool. Filter with native predicates before; the tool is called on what is left, a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = checker([t or "" for t in pdf[text]])
            yield pd.DataFrame({id_: pdf[id_], "valid": [bool(f.get("valid")) for f in found], "tier": [f.get("tier") for f in found], "errors": [list(f.get("errors") or []) for f in found], "log": [f.get("log") or "" for f in found]})

    kind = df.schema[id_].dataType.simpleString()
    return df.select(id_, text).mapInPandas(run, f"{id_} {kind}, valid boolean, tier string, errors array<string>, log string")


def mutation_probe(df: DataFrame, text: str, mutate: Callable, checker: Checker, id_: str) -> DataFrame:
    """Whether the checker notices that a text was weakened: id, tested (the mutation changes it), caught."""
    changed = df.select(id_, F.col(text).alias("__old"), mutate(F.col(text)).alias(text))
    tested = changed.filter(F.col(text) != F.col("__old"))
    found = checked(tested, text, checker, id_).select(id_, (~F.col("valid")).alias("caught"))
    return df.select(id_).join(found, id_, "left").select(id_, F.col("caught").isNotNull().alias("tested"), F.coalesce("caught", F.lit(False)).alias("caught"))


def routed(df: DataFrame, accepted) -> DataFrame:
    """A route column for a write partitioned by it, instead of two passes."""
    return df.withColumn("route", F.when(F.coalesce(accepted, F.lit(False)), "accepted").otherwise("rejected"))
