import pytest

from conftest import rows
from listenlake.plans import search


def titles(df):
    return sorted(r[0] for r in rows(df, "name"))


def test_tracks_match_title_artist_feature_or_album(small):
    assert titles(search.search_tracks(small, "two")) == ["Two"]
    assert titles(search.search_tracks(small, "bob")) == ["One", "Three"]
    assert titles(search.search_tracks(small, "blue")) == ["One", "Three", "Two"]


def test_unplayed_tracks_are_kept_unless_asked_not_to(small):
    assert rows(search.search_tracks(small, "silent"), "name", "play_count", "listening_time") == \
        [("Silent", 0, "0h 00m")]
    assert search.search_tracks(small, "silent", played_only=True).count() == 0


def test_only_ascii_letters_fold(small):
    assert titles(search.search_artists(small, "Éla")) == ["Élan"]
    assert titles(search.search_artists(small, "éla")) == []
    assert titles(search.search_artists(small, "LAN")) == ["Élan"]


@pytest.mark.parametrize("query, found", [
    ("%", ["100%_\\x", "Ann", "Ann", "Bob, Jr", "Élan"]),
    ("1_0", ["100%_\\x"]),
    ("b%r", ["Bob, Jr"]),
    ("\\x", ["100%_\\x"]),
    ("\\_", ["100%_\\x"]),
    ("\\%", ["100%_\\x"]),
    ("\\n", []),
])
def test_wildcards_pass_through_and_backslash_is_plain(small, query, found):
    assert titles(search.search_artists(small, query)) == found


@pytest.mark.parametrize("query", ["bob", "a", "jr", " j", "n, b", "r, é", "ann%lan", "n_, ", ", ", "Jr, Ann", " "])
def test_both_ways_to_match_artists_agree(small, query, monkeypatch):
    quick = titles(search.search_tracks(small, query))
    monkeypatch.setattr(search, "spans_names", lambda q: True)
    assert quick == titles(search.search_tracks(small, query))


def test_albums_match_name_or_owner(small):
    assert titles(search.search_albums(small, "ann")) == ["Blue"]
    assert titles(search.search_albums(small, "LIVE")) == ["Blue Live"]
    assert rows(search.search_albums(small, "empty"), "name", "artist", "play_count") == [("Empty", "Élan", 0)]
