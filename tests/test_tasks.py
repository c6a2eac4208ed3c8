"""Work on small rows is dealt to tasks by rows, not by the bytes of the file they come from."""

from tessera.plans import rules, specs

SF = "/root/testdata/sf0.1"


def test_specifications_are_dealt(spark):
    assert specs.spec_table(spark, SF).rdd.getNumPartitions() > 1


def test_stages_are_found_after_the_deal(spark):
    plan = specs.staged_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.split("Repartition", 1)[1]


def test_cases_are_dealt(spark):
    assert rules.module_table(spark, SF).rdd.getNumPartitions() > 1
