"""Sums by library and artist from lists of numbers: worker functions, the cut of lists, the plan."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from listenlake.checks import fixtures
from listenlake.operators import credits, lists
from listenlake.operators.rollup import per_track
from listenlake.plans import reports


def summed(rows, size, by="total_ms", limit=-1):
    """`sum_lists` of (library, numbers, ms, plays) rows, sent in batches of `size` rows."""
    schema = pa.schema([("library", pa.string()), ("artists", pa.list_(pa.int32())), ("total_ms", pa.int64()), ("play_count", pa.int64())])
    batches = [pa.record_batch([list(c) for c in zip(*rows[i:i + size])], schema=schema) for i in range(0, len(rows), size)]
    out = []
    for batch in lists.sum_lists(by, limit, batches):
        for row in batch.to_pylist():
            assert len(row["sums"]) <= lists.SUMS_A_ROW
            out += [(row["library"], *s.values()) for s in row["sums"]]
    return out


@pytest.mark.parametrize("at_once, size", [(1, 1), (7, 3), (50, 11), (1 << 17, 1000)])
@pytest.mark.parametrize("limit", [-1, 2])
def test_sums_equal_a_plain_loop_however_rows_are_sent(monkeypatch, at_once, size, limit):
    monkeypatch.setattr(lists, "NUMBERS_AT_ONCE", at_once)
    monkeypatch.setattr(lists, "SUMS_A_ROW", 3)
    rng = random.Random(at_once * 100 + size)
    rows = [(library, rng.sample(range(1, 9), rng.randint(1, 5)), rng.randint(0, 3), 1)
            for library in (None, "a", "b", "c") for _ in range(rng.randint(1, 30))]
    want = defaultdict(lambda: [0, 0])
    for library, numbers, ms, plays in rows:
        for n in numbers:
            want[library, n][0] += ms
            want[library, n][1] += plays
    want = sorted(((*k, *v) for k, v in want.items()), key=lambda r: (r[0] or "", -r[2], r[1]))
    if limit > 0:
        want = [r for i, r in enumerate(want) if sum(x[0] == r[0] for x in want[:i]) < limit]
    assert sorted(summed(rows, size, limit=limit), key=lambda r: (r[0] or "", -r[2], r[1])) == want


def test_sums_beyond_a_long_fail_and_large_ones_are_exact():
    big = 1 << 62
    assert summed([("a", [1], big, 1), ("a", [1], -big, 1), ("a", [1, 2], big, 1)], 2) == [("a", 1, big, 3), ("a", 2, big, 1)]
    with pytest.raises(OverflowError):
        summed([("a", [1], big, 1), ("a", [1], big, 1)], 2)


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_lists_hold_each_number_once_also_where_hashes_meet(monkeypatch, size):
    monkeypatch.setattr(lists, "LIST_SIZE", 2)
    monkeypatch.setattr(lists, "NUMBERS_AT_ONCE", 3)
    rows = [("t1", 5, -7), ("t2", 5, -7), ("t1", 4, -7), ("t1", 5, -7), ("t1", 6, -7), ("t3", 1, 0), ("t4", 2, 9), ("t4", 2, 9)]
    batches = [pa.record_batch([list(c) for c in zip(*rows[i:i + size])], names=["track_isrc", "artist_no", "_hash"]).cast(
        pa.schema([("track_isrc", pa.string()), ("artist_no", pa.int32()), ("_hash", pa.int64())])) for i in range(0, len(rows), size)]
    got = [(r["track_isrc"], r["artists"]) for b in lists.list_numbers(batches) for r in b.to_pylist()]
    assert sorted(got) == [("t1", [4, 5]), ("t1", [6]), ("t2", [5]), ("t3", [1]), ("t4", [2])]


def lake_of(make_lake):
    return make_lake(
        artists=[(f"a{i}", f"Name {i}", i) for i in range(5)],
        tracks=[("t1", "One", "a0", None), ("t2", "Two", "a1", None), (None, "Lost", "a2", None)],
        features=[("t1", "a2"), ("t1", "a3"), ("t2", "a4"), ("t2", "a3"), (None, "a0")],
        plays=[("x", "t1", "2020-01-01", 5), ("x", "t2", "2020-01-01", 5), ("y", "t2", "2020-01-01", 9), (None, "t1", "2020-01-01", 1)])


def test_lists_per_library_are_cut_before_they_leave_the_workers(spark, make_lake):
    lk = lake_of(make_lake)
    limit_of_bytes = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    numbers = credits.number_artists(credits.all_artists(lk))
    got = credits.per_library_artist(lk, per_track(lk.plays, ["library"]), numbers, limit=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("x", 1, 5, 1), ("x", 4, 10, 2), ("y", 2, 9, 1), ("y", 4, 9, 1), (None, 1, 1, 1), (None, 3, 1, 1)], key=str)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit_of_bytes
    # A report asks for no more than its limit.
    wide = reports.top_artists_keyed(lk, limit=1, per_library=True)
    assert "Generate inline" in wide._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["library"] or "", r["artist_id"]) for r in wide.collect()) == [("", "a0"), ("x", "a3"), ("y", "a1")]


def test_sums_by_library_and_artist_hold_one_library_not_a_task(make_lake):
    lk = lake_of(make_lake)
    numbers = credits.number_artists(credits.all_artists(lk))
    plan = credits.per_library_artist(lk, per_track(lk.plays, ["library"]), numbers)._jdf.queryExecution().optimizedPlan().toString()
    # Between the shuffle to a library and the result rows are sorted and summed in workers; no hash table of pairs.
    above = plan[:plan.index("RepartitionByExpression")]
    assert "MapInArrow" in above and "Sort [library" in above and "Aggregate" not in above


def test_features_are_made_distinct_as_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (1, 2), (1, None), (1, None), (None, 2), (12, 2), (1, 22)], "l_partkey bigint, l_suppkey bigint")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    features = fixtures.track_features(spark, str(tmp_path))
    assert "Aggregate [l_partkey" in features._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, features.collect()), key=str) == sorted(
        [("1", "S2"), ("1", None), (None, "S2"), ("12", "S2"), ("1", "S22")], key=str)
