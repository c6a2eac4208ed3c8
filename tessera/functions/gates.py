"""Conditions that rows must meet before they are trained on. A condition on null is false unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a failed annotation begins.
FAILED = "[annotation failed"


def _so(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def tier_allowed(tier: Column, silver: bool = True, bronze: bool = False) -> Column:
    return _so(tier.isin("gold", *(["silver"] if silver else []), *(["bronze"] if bronze else [])))


def credit_floor(credit: Column, floor: float) -> Column:
    """Only a credit that is there and below the floor fails."""
    return F.coalesce(credit >= floor, F.lit(True))


def within_budget(prompt: Column, chosen: Column, rejected: Column, limit: int) -> Column:
    """The prompt and the longer answer have at most so many characters; null has none."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return n(prompt) + F.greatest(n(chosen), n(rejected)) <= limit


def headroom(score: Column, low: float, high: float) -> Column:
    return _so(score.between(low, high))


def core_structure(spec: Column) -> Column:
    """Initial state, next state and variables are named."""
    return _so(spec.rlike(r"\bInit\b") & spec.rlike(r"\bNext\b") & spec.rlike(r"\bVARIABLE"))


def is_stub(spec: Column, least: int = 10) -> Column:
    """No definition of Init or of Next, or fewer lines than these that are neither blank nor a line comment."""
    lines = F.filter(F.transform(F.split(spec, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("\\*"))
    return ~_so(spec.rlike(r"(?m)^Init\s*==") & spec.rlike(r"(?m)^Next\s*==") & (F.size(lines) >= least))


def reasoned(text: Column, least: int = 200) -> Column:
    return _so(F.length(text) >= least)


def annotated(text: Column, failed: str = FAILED) -> Column:
    """A description is there and tells no failure: the row needn't be annotated again."""
    return _so((text != "") & ~text.startswith(failed))


def require_rows(df: DataFrame, least: int, what: str = "rows") -> DataFrame:
    """df, or an error if it has fewer rows; only so many are counted."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} {what}, {least} are needed")
    return df
