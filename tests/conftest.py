import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from listenlake.lake import Lake  # noqa: E402
from listenlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tables here have a few rows: compiling each plan would take longer than running it.
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.codegen.wholeStage": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_lake(spark):
    """A lake from short row lists; dates are given as text."""

    def make(artists=(), albums=(), tracks=(), features=(), plays=()) -> Lake:
        def frame(rows, schema):
            return spark.createDataFrame(list(rows), schema)

        played = frame(plays, "library string, track_isrc string, day string, ms_played long")
        return Lake(
            artists=frame(artists, "id string, name string, seq long"),
            albums=frame(albums, "id string, name string, artist_id string, album_type string, seq long"),
            tracks=frame(tracks, "isrc string, title string, artist_id string, album_id string"),
            track_features=frame(features, "track_isrc string, artist_id string"),
            plays=played.selectExpr("library", "track_isrc", "cast(day as date) as played_at_date",
                                    "'10:00' as played_at_time", "ms_played", "'Spotify' as source"),
        )

    return make


@pytest.fixture(scope="session")
def small(make_lake):
    """Five artists, one featured on their own track, one track nobody played, one play without a code."""
    return make_lake(
        artists=[("a1", "Ann", 1), ("a2", "Bob, Jr", 2), ("a3", "Élan", 3), ("a4", "Ann", 0), ("a5", "100%_\\x", 5)],
        albums=[("b1", "Blue", "a1", "album", 1), ("b2", "Blue Live", "a2", "album", 2),
                ("b3", "Empty", "a3", "single", 3)],
        tracks=[("t1", "One", "a1", "b1"), ("t2", "Two", "a1", "b1"), ("t3", "Three", "a2", "b2"),
                ("t4", "Four", "a3", None), ("t5", "Silent", "a5", "b3")],
        features=[("t1", "a1"), ("t1", "a3"), ("t1", "a2"), ("t3", "a1")],
        plays=[("x", "t1", "2020-01-01", 60000), ("x", "t1", "2020-12-31", 30000), ("y", "t2", "2021-01-01", 90000),
               ("x", "t3", "2020-06-01", 3600000), ("y", "t4", "2020-06-02", 40000), ("x", None, "2020-06-03", 50000)],
    )


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
