import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from listenlake.plans import imports, reports
from listenlake.schemas import TRACK_METADATA
from listenlake.sources import history
from listenlake.sources.store import LakeStore
from listenlake.streaming.append import append_history
from test_sources import listen, sheet, write_history

URL = "https://open.spotify.com/track/"


def track(id, isrc, album, kind="album", n=10, artists=("Ann",), rank=1, title=None, page=None):
    return {"id": id, "name": title or f"Song {isrc}", "duration_ms": 1000, "external_ids": {"isrc": isrc},
            "external_urls": {"spotify": URL + (page or id)},
            "album": {"id": album, "name": album, "album_type": kind, "total_tracks": n},
            "artists": [{"id": a.lower(), "name": a} for a in artists], "search_rank": rank}


@pytest.fixture
def metadata(spark):
    return lambda *tracks: spark.createDataFrame(list(tracks), TRACK_METADATA)


@pytest.fixture
def listens_a(spark, tmp_path):
    def make(*ids):
        folder = tmp_path / f"a{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        write_history(folder, "Streaming_History_Audio_1.json", [
            listen(uri=i and f"spotify:track:{i}") for i in ids
        ])
        return history.normalize_a(history.read_history_json(spark, str(folder)), "me")
    return make


@pytest.fixture
def listens_b(spark):
    def make(*codes):
        rows_ = [("f", i, *sheet(ISRC=c, **{"Listening Time": 60.0}).values()) for i, c in enumerate(codes)]
        return history.normalize_b(spark.createDataFrame(rows_, history.SHEET_ROWS), "me")
    return make


@pytest.fixture
def store(spark, tmp_path):
    return LakeStore(spark, str(tmp_path / "lake"), buckets=2)


@pytest.fixture
def empty(store):
    return store.empty()


def test_platform_a_picks_the_best_release_and_first_seen_on_ties(metadata, listens_a, empty):
    found = metadata(
        track("s", "I1", "single", "single"), track("a", "I1", "short", n=5), track("b", "I1", "long", n=9),
        track("c", "I1", "long too", n=9), track("z", None, "no code"),
    )
    lake = imports.import_a(empty, listens_a("s", "c", "b", "a", "z", None, "unknown"), found)
    assert rows(lake.tracks, "isrc", "album_id", "spotify_id") == [("I1", "long too", "c")]
    assert rows(lake.albums, "id") == [("long too",)]
    # Every id of the recording counts; an unknown id keeps its play without a code.
    assert sorted(rows(lake.plays.groupBy("track_isrc").count()), key=str) == [("I1", 4), (None, 2)]


def test_features_and_album_owner(metadata, listens_a, empty):
    found = metadata(
        track("a", "I1", "shared", artists=("Ann", "Bob", "Ann", "Bob")), track("b", "I2", "shared", artists=("Bob",)),
    )
    lake = imports.import_a(empty, listens_a("b", "a"), found)
    assert rows(lake.albums, "id", "artist_id") == [("shared", "bob")]
    assert sorted(rows(lake.track_features)) == [("I1", "ann"), ("I1", "bob")]
    assert sorted(rows(lake.artists, "id", "name")) == [("ann", "Ann"), ("bob", "Bob")]


def test_a_page_with_another_id_leaves_the_play_unresolved(metadata, listens_a, empty):
    lake = imports.import_a(empty, listens_a("old", "new"), metadata(track("old", "I1", "x", page="new")))
    assert sorted(rows(lake.plays, "track_isrc"), key=str) == [("I1",), (None,)]


def test_a_later_import_resolves_ids_seen_before(metadata, listens_a, empty):
    found = metadata(track("a", "I1", "x"), track("b", "I1", "y", n=3))
    lake = imports.import_a(empty, listens_a("a", "b"), found)
    lake = imports.import_a(lake, listens_a("a", "b", "b"), found, batch=1)
    assert rows(lake.plays.groupBy("track_isrc").count()) == [("I1", 5)]


def test_platform_a_never_upgrades_and_b_does_when_strictly_better(metadata, listens_a, listens_b, empty):
    lake = imports.import_a(empty, listens_a("s"), metadata(track("s", "I1", "single", "single", artists=("Ann", "Bob"))))
    better = metadata(track("l", "I1", "full", "album", artists=("Zed", "Yan"), title="Other"),
                      track("s2", "I2", "same", "single", rank=2), track("c2", "I2", "comp", "compilation", rank=1))
    # Platform A leaves the stored track, but credits the new release's features on it.
    again = metadata(track("l", "I1", "full", "album", artists=("Zed", "Cat")))
    lake = imports.import_a(lake, listens_a("l"), again, batch=1)
    assert rows(lake.tracks, "isrc", "album_id") == [("I1", "single")]
    assert sorted(rows(lake.track_features)) == [("I1", "bob"), ("I1", "cat")]
    lake = imports.import_b(lake, listens_b("I1", "I2", "I3", None), better, batch=2)
    assert sorted(rows(lake.tracks, "isrc", "title", "artist_id", "album_id", "spotify_id")) == [
        ("I1", "Other", "ann", "full", "l"), ("I2", "Song I2", "ann", "comp", "c2"),
    ]
    # The upgrade keeps the features and does not bring its own.
    assert sorted(rows(lake.track_features)) == [("I1", "bob"), ("I1", "cat")]
    # Only plays with a known code are taken, under the other source.
    assert sorted(rows(lake.plays.filter("source = 'Deezer'"), "track_isrc")) == [("I1",), ("I2",)]
    same = imports.import_b(lake, listens_b("I1"), metadata(track("q", "I1", "again", "album")), batch=3)
    assert rows(same.tracks.filter("isrc = 'I1'"), "album_id") == [("full",)]


def test_every_candidate_is_looked_at(metadata, listens_b, empty):
    found = metadata(*[track(f"r{i}", "I1", f"al{i}", "single", n=i, rank=i) for i in range(1, 6)])
    lake = imports.import_b(empty, listens_b("I1"), found)
    assert rows(lake.tracks, "spotify_id") == [("r5",)]


def test_editions_merge_and_totals_stay(metadata, listens_a, store):
    found = metadata(track("a", "I1", "Blue"), track("b", "I2", "Blue (Deluxe Edition)"))
    lake = imports.import_library(store, "1", listens_a("a", "b", "b"), None, found)
    assert rows(lake.albums, "id") == [("Blue (Deluxe Edition)",)]
    assert rows(reports.top_albums(lake), "album", "play_count") == [("Blue (Deluxe Edition)", 3)]


def test_a_finished_import_is_not_repeated(metadata, listens_a, store):
    found = metadata(track("a", "I1", "x"))
    for _ in range(2):
        lake = imports.import_library(store, "1", listens_a("a"), None, found)
    assert lake.plays.count() == 1
    # Another name imports the same plays again, unless they are deduplicated.
    assert imports.import_library(store, "2", listens_a("a"), None, found).plays.count() == 2


def test_an_import_that_broke_off_is_written_over(metadata, listens_a, store):
    found, listens = metadata(track("a", "I1", "x")), listens_a("a")
    store.create()
    store.append_plays(imports.resolve_plays(listens, imports.known_aliases(store.read())), "1")
    lake = imports.import_library(store, "1", listens, None, found)
    assert rows(lake.plays, "track_isrc") == [("I1",)]


def test_stream_takes_each_file_once(spark, tmp_path, metadata, listens_a, store):
    imports.import_library(store, "1", listens_a("a"), None, metadata(track("a", "I1", "x")))
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    folder.mkdir()
    write_history(folder, "Streaming_History_Audio_1.json", [listen(uri="spotify:track:a"), listen(ms=1)])
    write_history(folder, "._Streaming_History_Audio_1.json", [listen()])

    def append():
        append_history(store, str(folder), checkpoint, "s", "me")
        return sorted(rows(store.read().plays.groupBy("track_isrc").count()), key=str)

    assert append() == append() == [("I1", 2)]
    write_history(folder, "Streaming_History_Audio_2.json", [listen(uri="spotify:track:new")])
    assert append() == [("I1", 2), (None, 1)]
