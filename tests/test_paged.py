"""The paged source over recorded responses."""


from tessera.sources import paged

SCHEMA = "query string, page_id long, url string"


def test_pages_resume_and_dedup(spark, tmp_path):
    rows = [("a b/é", i, f"u{i % 7}") for i in range(25)] + [("b", 3, "u3"), ("b", 5, "u\u2028\n5"), ("b", 24, None), ("b", 24, None), (None, 1, "x"), ("b", None, "x"), ("c", -1, "x")]
    folder = f"{tmp_path}/responses"
    paged.record(spark.createDataFrame(rows, SCHEMA), folder, per_page=10)
    found = paged.search(spark, folder, ["a b/é", "b", "nothing"], 3)
    assert found.rdd.getNumPartitions() == 9
    want = sorted((q, i // 10, i, u or "") for q, i, u in rows if q in ("a b/é", "b") and i is not None)
    assert sorted((r.query, r.page, r.page_id, r.url or "") for r in found.collect()) == want
    rest = paged.search(spark, folder, ["a b/é", "b"], 3, {"a b/é": 1})
    assert sorted((r.query, r.page) for r in rest.select("query", "page").distinct().collect()) == [("a b/é", 2), ("b", 0), ("b", 2)]
    assert {r.query: r.page for r in paged.offsets(found).collect()} == {"a b/é": 2, "b": 2}
    urls = {r.url: (r.page_id, r.queries) for r in paged.by_url(found).collect()}
    assert urls == {f"u{i}": (i, 2 if i == 3 else 1) for i in range(7)} | {"u\u2028\n5": (5, 1)}
    assert paged.search(spark, folder, ["b"], 0).count() == 0


def test_nothing_recorded(spark, tmp_path):
    folder = f"file:{tmp_path}/none"
    paged.record(spark.createDataFrame([], SCHEMA), folder)
    assert paged.by_url(paged.search(spark, folder, ["a"], 2)).count() == 0
