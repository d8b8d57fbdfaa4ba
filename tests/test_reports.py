import pytest
from pyspark.sql import functions as F

from conftest import rows
from listenlake.operators import credits
from listenlake.operators.rollup import count_entities, per_track
from listenlake.plans import details, reports
from listenlake.session import tasks_for


def test_general_stats_counts_time_of_unresolved_plays(small):
    stats = reports.general_stats(small).first().asDict()
    assert stats == {"listening_time": "1h 04m", "total_plays": 5, "total_tracks": 4, "total_artists": 3,
                     "total_albums": 2}


def test_general_stats_of_an_empty_range_is_one_row(small):
    assert rows(reports.general_stats(small, "1990-01-01", "1990-12-31")) == [("0h 00m", 0, 0, 0, 0)]


def test_range_includes_both_ends_and_empty_bounds_are_open(small):
    assert reports.general_stats(small, "2020-01-01", "2020-12-31").first()["total_plays"] == 4
    assert reports.general_stats(small, "2020-12-31", "2020-12-31").first()["total_plays"] == 1
    assert reports.general_stats(small, "", "").first()["total_plays"] == 5


def test_names_list_the_main_artist_first_then_features_by_id(small):
    named = dict(rows(reports.top_tracks(small), "title", "artist"))
    assert named["One"] == "Ann, Ann, Bob, Jr, Élan"
    assert named["Three"] == "Bob, Jr, Ann"
    assert set(named) == {"One", "Two", "Three", "Four"}


def test_order_by_time_or_plays_with_ties_by_key(small):
    assert [r[0] for r in rows(reports.top_tracks(small, param=0), "title")] == ["Three", "One", "Two", "Four"]
    assert [r[0] for r in rows(reports.top_tracks(small, param=1), "title")] == ["One", "Two", "Three", "Four"]
    assert [r[0] for r in rows(reports.top_tracks(small, param=7, limit=1), "title")] == ["Three"]


def test_negative_limit_keeps_all_and_zero_none(small):
    assert reports.top_tracks(small, limit=-1).count() == 4
    assert reports.top_tracks(small, limit=0).count() == 0


def test_artist_featured_on_their_own_track_counts_once(small):
    totals = {r["name"] + str(r["total_ms"]): r["play_count"] for r in reports.top_artists(small, limit=-1).collect()}
    # Ann (a1): t1 twice, t2 once, t3 as a feature.
    assert totals[f"Ann{60000 + 30000 + 90000 + 3600000}"] == 4


def test_main_artist_display(small):
    assert dict(rows(reports.top_tracks(small, artist_display="main"), "title", "artist"))["Three"] == "Bob, Jr"


def test_plays_add_up(small):
    tracks = reports.top_tracks(small, limit=-1).agg(F.sum("play_count")).first()[0]
    assert tracks == reports.general_stats(small).first()["total_plays"]


def test_artist_reports_include_features_and_skip_tracks_without_album(small):
    assert [r[0] for r in rows(reports.artist_top_tracks(small, "a3"), "title")] == ["One"]
    assert rows(reports.artist_stats(small, "a3"), "total_plays", "unique_tracks", "first_listen") == \
        [(3, 2, "2020-01-01")]
    assert rows(reports.artist_top_albums(small, "a1"), "album", "artist", "play_count") == \
        [("Blue Live", "Ann", 1), ("Blue", "Ann", 3)]


def test_artist_top_tracks_honours_dates(small):
    assert [r[0] for r in rows(reports.artist_top_tracks(small, "a1", start="2021-01-01"), "title")] == ["Two"]


def test_stats_of_something_never_played(small):
    assert rows(reports.artist_stats(small, "a5")) == [(0, 0, "0h 00m", 0, "N/A")]
    assert rows(reports.album_stats(small, "b3")) == [(0, 0, "0h 00m", 0, "N/A")]


def test_library_scopes(small):
    assert reports.general_stats(small, library="y").first()["total_plays"] == 2
    per = reports.top_tracks(small, limit=1, per_library=True)
    assert rows(per, "library", "title") == [("x", "Three"), ("y", "Two")]
    # Results do not depend on how many libraries are asked at once.
    for library in ("x", "y"):
        single = rows(reports.top_artists(small, limit=2, library=library))
        together = reports.top_artists(small, limit=2, per_library=True).filter(F.col("library") == library)
        assert rows(together.drop("library")) == single


def test_homonyms_take_the_first_arrival_and_case_matters(small):
    assert details.find_artist_id(small, "Ann").first()["id"] == "a4"
    assert details.find_artist_id(small, "ann").first()["id"] is None


def test_details_of_an_unknown_name_are_empty(small):
    assert details.artist_detail(small, "nobody").count() == 0
    assert details.album_detail(small, "nothing").count() == 0


def test_album_detail(small):
    got = details.album_detail(small, "Blue").collect()
    stats = [r for r in got if r["section"] == "stats"][0]
    assert (stats["artist"], stats["play_count"], stats["unique_tracks"], stats["first_listen"]) == \
        ("Ann", 3, 2, "2020-01-01")
    assert [(r["rank"], r["name"]) for r in got if r["section"] == "tracks"] == [(1, "One"), (2, "Two")]


@pytest.mark.parametrize("limit, ranks", [(2, [1, 2]), (-1, [1, 2, 3, 4])])
def test_ranks_follow_the_limit(small, limit, ranks):
    got = details.dashboard(small, limit=limit).filter("section = 'tracks'").collect()
    assert [r["rank"] for r in got] == ranks


def test_long_lists_are_numbered_part_by_part(spark):
    from listenlake.operators.topk import number_rows

    df = spark.range(500).selectExpr("id", "id % 7 as plays").repartition(5)
    got = number_rows(df, [F.desc("plays"), "id"]).collect()
    want = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert {r.id: r["rank"] for r in got} == {i: k + 1 for k, i in enumerate(want)}


def test_keyed_reports_filter_plays_before_summing(small):
    for df in (reports.artist_stats(small, "a1"), reports.album_tracks(small, "b1"), reports.artist_top_albums(small, "a1")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [i for i, line in enumerate(plan) if "Join LeftSemi" in line]
        sums = [i for i, line in enumerate(plan) if "Aggregate [track_isrc" in line or "Aggregate [coalesce(track_isrc" in line or "Aggregate [_groupingexpression" in line]
        assert joins and sums and min(sums) < max(joins)


def test_one_hit_in_all_lists_is_named_once(spark, make_lake):
    lake = make_lake(
        artists=[("a1", "Ann", 1), ("a2", "Bob", 2)], tracks=[("t1", "One", "a1", None)], features=[("t1", "a2")],
        plays=[(f"x{i}", "t1", "2020-01-01", 60000) for i in range(50)])
    df = reports.top_tracks(lake, per_library=True)
    assert {r["artist"] for r in df.collect()} == {"Ann, Bob"} and df.count() == 50
    assert "REPARTITION_BY_COL" not in df._jdf.queryExecution().executedPlan().toString()


def test_dashboard_scans_plays_once(spark, small, tmp_path):
    path = str(tmp_path / "plays")
    small.plays.write.parquet(path)
    stored = small.with_tables(plays=spark.read.parquet(path))
    df = details.dashboard(stored)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("ms_played") > 0
    assert sum("FileScan parquet" in line and "ms_played" in line for line in final.splitlines()) == 1


@pytest.mark.parametrize("large", [1_000_000, 2, 0])
def test_sums_by_library_and_artist_unfold_lists_of_numbers(make_lake, large, monkeypatch):
    monkeypatch.setattr(credits, "LARGE_LIBRARY", large)
    lk = make_lake(
        tracks=[("t1", "One", "a1", "b1"), ("t1", "One", "a2", "b1"), ("t2", "Two", None, "b1"), ("t3", "Three", "a9", None)],
        features=[("t1", "a1"), ("t1", "a3"), ("t2", "a1"), ("t2", "a1")],
        plays=[("x", "t1", "2020-01-01", 1), ("x", "t1", "2020-01-02", 2), ("x", "t2", "2020-01-01", 4),
               (None, "t2", "2020-01-01", 8), ("y", "t3", "2020-01-01", 16), ("y", None, "2020-01-01", 32)],
    )
    numbers = credits.number_artists(credits.all_artists(lk))
    summed = credits.per_library_artist(lk, per_track(lk.plays, ["library"]), numbers)
    # The shuffle to a library carries lists: nothing is unfolded below it.
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert large < 1_000_000 or plan.index("Generate") < plan.index("RepartitionByExpression")
    got = summed.join(numbers, "artist_no").select("library", "artist_id", "total_ms", "play_count").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("x", "a1", 7, 3), ("x", "a2", 3, 2), ("x", "a3", 3, 2), ("x", None, 4, 1),
        (None, "a1", 8, 1), (None, None, 8, 1), ("y", "a9", 16, 1),
    ], key=str)


def test_top_artists_per_library_skips_artists_without_id_before_the_cut(make_lake):
    lk = make_lake(
        artists=[("a1", "Ann", 1), ("a1", "Anne", 2), (None, "Nobody", 3), ("a2", "Bob", 4)],
        tracks=[("t1", "One", "a1", "b1"), ("t2", "Two", None, "b1"), ("t3", "Three", "a2", "b1")],
        plays=[("x", "t1", "2020-01-01", 40_000), ("x", "t2", "2020-01-01", 90_000), ("x", "t3", "2020-01-01", 30_000)],
    )
    got = reports.top_artists(lk, limit=3, per_library=True).select("name", "total_ms").collect()
    assert sorted(map(tuple, got)) == [("Ann", 40_000), ("Anne", 40_000), ("Bob", 30_000)]


def test_distinct_values_are_counted_without_holding_a_row_once_for_each_count(spark):
    rows = spark.createDataFrame([("x", "t1", "a1", None), ("x", "t1", "a2", "b"), ("x", "t2", "a1", "b"), (None, None, "a1", None)],
                                 "library string, isrc string, artist_id string, album_id string")
    counted = count_entities(rows, "library", {"tracks": "isrc", "artists": "artist_id", "albums": "album_id"}, 3)
    assert "Expand" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, counted.collect()), key=str) == [("x", 2, 2, 1), (None, 0, 1, 0)]
    assert [tasks_for(spark, n) for n in (0, 500_000 * 9, 500_000 * 9 + 1)] == [2, 9, 10]
