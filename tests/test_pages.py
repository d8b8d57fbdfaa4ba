"""Continued lists: pages by cursor equal slices of the whole ranking, ties on page borders included."""

from pyspark.sql import functions as F

from listenlake.operators import pages


def test_pages_equal_slices_of_the_ranking(spark, monkeypatch):
    monkeypatch.setattr(pages, "BLOCK", 7)
    # Many ties: metric values repeat, so page borders fall inside groups of equal metric.
    rows = [(f"k{i:03d}", (i * 37) % 11) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, m long")
    want = [k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    ranking = pages.StoredRanking.store(df, "m", "key")
    for size in (1, 5, 7, 13, 100, 150):
        got, cursor = [], None
        while True:
            page = ranking.page(cursor, size)
            keys = [r["key"] for r in page.collect()]
            if not keys:
                break
            assert len(keys) <= size
            got += keys
            cursor = ranking.cursor(page)
        assert got == want, size
    read = pages.pages(ranking, 13, ["key", "m"])
    assert [r["key"] for r in read.orderBy("rank").collect()] == want
    assert read.agg(F.max("page")).first()[0] == (len(rows) - 1) // 13


def test_a_cursor_of_another_ranking_starts_behind_its_row(spark):
    df = spark.createDataFrame([(f"k{i}", i % 4) for i in range(20)], "key string, m long")
    ranking = pages.StoredRanking.store(df, "m", "key")
    # A cursor whose row is not at its rank here: the page starts behind (metric 2, key 'k2').
    page = ranking.page(pages.Cursor(rank=1, metric=2, key="k2"), 3)
    assert [(r["key"], r["m"]) for r in page.collect()] == [("k6", 2), ("k1", 1), ("k13", 1)]


def test_empty_ranking(spark):
    ranking = pages.StoredRanking.store(spark.createDataFrame([], "key string, m long"), "m", "key")
    assert ranking.page(None, 5).count() == 0 and pages.pages(ranking, 5, ["key"]).count() == 0


def test_reading_all_pages_is_one_plan_of_fixed_size(spark):
    frame = spark.createDataFrame([(f"k{i:03d}", i // 7) for i in range(120)], "key string, n long")
    ranking = pages.StoredRanking.store(frame, "n", "key")
    read = pages.pages(ranking, 5, ["key"])
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    want = sorted(((f"k{i:03d}", i // 7) for i in range(120)), key=lambda r: (-r[1], r[0]))
    got = read.orderBy("rank").collect()
    assert [(r["key"], r["page"]) for r in got] == [(k, i // 5) for i, (k, _) in enumerate(want)]
    cursors = {r["page"]: (r["rank"], r["metric"], r["key"]) for r in ranking.cursors(5).collect()}
    assert cursors[3] == (15, want[14][1], want[14][0]) and cursors[0] == (0, None, None)
