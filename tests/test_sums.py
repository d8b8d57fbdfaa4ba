"""The time hierarchy of partial sums gives the totals of plays for any range."""

import datetime as dt
import random

from listenlake.operators import sums
from listenlake.operators.rollup import rollup


def test_range_parts_cover_each_day_once():
    rng = random.Random(3)
    for _ in range(3000):
        a = dt.date(1994, 1, 1) + dt.timedelta(days=rng.randrange(3000))
        b = a + dt.timedelta(days=rng.randrange(-2, 2000))
        days = []
        for level, low, high in sums.pieces(a, b):
            lo, hi = (dt.date(low, 1, 1), dt.date(high, 12, 31)) if level == "year" else (low, high)
            days += [lo + dt.timedelta(days=i) for i in range((hi - lo).days + 1)]
        assert sorted(days) == [a + dt.timedelta(days=i) for i in range((b - a).days + 1)]
        assert len([p for p in sums.pieces(a, b) if p[0] == "day"]) <= 2


def test_sums_equal_plays_on_random_ranges(spark, make_lake):
    rng = random.Random(7)
    plays = [(f"L{rng.randrange(3)}", rng.choice(["t1", "t2", "t3", None]), str(dt.date(1999, 1, 1) + dt.timedelta(days=rng.randrange(900))),
              rng.randrange(1000, 90000)) for _ in range(400)]
    lk = make_lake(plays=plays)
    stored = sums.Sums.build(lk)
    ranges = [(None, None), ("1999-01-01", "2001-06-19"), ("1999-03-01", "2000-12-31")]
    for _ in range(17):
        a = dt.date(1998, 12, 1) + dt.timedelta(days=rng.randrange(950))
        ranges.append((str(a), str(a + dt.timedelta(days=rng.randrange(0, 700)))))
    for start, end in ranges:
        for library, per_library in ((None, False), ("L1", False), (None, True)):
            want = sorted(tuple(r) for r in rollup(lk, start, end, library, per_library).collect())
            got = sorted(tuple(r) for r in stored.rollup(start, end, library, per_library).collect())
            assert got == want, (start, end, library, per_library)
    # A later batch is added as more rows.
    more = make_lake(plays=plays[:50]).plays
    stored.add(more)
    both = lk.with_tables(plays=lk.plays.unionByName(more))
    assert sorted(tuple(r) for r in stored.rollup("1999-02-03", "2001-01-30").collect()) == sorted(
        tuple(r) for r in rollup(both, "1999-02-03", "2001-01-30").collect())
