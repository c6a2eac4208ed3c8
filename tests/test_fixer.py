"""The module fixer and the sanitiser, a hand-made row for each rule; the queries over parts have the same rows."""

from pyspark.sql import functions as F

from tessera.functions import fixer, sanitiser
from tessera.plans.specs import FIXES, SANITISED


def fix(spark, *rows):
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, e string")
    return [r.f for r in sorted(fixer.with_fixed(out, F.col("t"), F.col("e"), "f").select("i", "f").collect())]


def test_each_rule_by_hand(spark):
    for (_, text, errors, want, rules), got in zip(FIXES, fix(spark, *[(c[1], c[2]) for c in FIXES]), strict=True):
        assert got.text == want, text
        assert ",".join(got.rules) == rules, text


def test_every_reported_rule_has_a_row():
    assert {name for name, _ in fixer.WHOLE_RULES + fixer.CODE_RULES if name} == {r for c in FIXES for r in c[4].split(",") if r}


def test_fixed_texts_stay(spark):
    again = fix(spark, *[(c[3], None) for c in FIXES])
    assert [a.text for a in again] == [c[3] for c in FIXES]
    assert not [a.rules for a in again if a.rules]


def test_odd_texts(spark):
    long = "---- MODULE M ----\n" + "\n".join(f"D{i} == \"x'' \\notin S\" (* EXISTS x *) \\* FORALL \U0001f600" for i in range(20_000)) + "\n===="
    null, empty, kept, marks = fix(spark, (None, None), ("", ""), (long, "level error"), ("﷐A == 1﷒\n====", None))
    assert null == empty == ("====", ["added missing ==== delimiter"])
    assert kept == (long, []) and marks == ("A == 1\n====", [])


def test_each_sanitiser_rule_by_hand(spark):
    cases = spark.createDataFrame([c[:2] for c in SANITISED], "i int, t string")
    got = {r.i: r.s for r in sanitiser.with_sanitised(cases, F.col("t"), "s").select("i", "s").collect()}
    for i, _, want, rules in SANITISED:
        assert (got[i].text, ",".join(got[i].rules)) == (want, rules), i
    assert {name for name, _ in sanitiser.WHOLE_RULES + sanitiser.CODE_RULES} == {r for c in SANITISED for r in c[3].split(",")}
