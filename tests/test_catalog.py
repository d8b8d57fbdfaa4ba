import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from listenlake.functions import media, text
from listenlake.operators import editions, releases
from listenlake.schemas import EDITION_WORDS, EDITION_WORDS_V3, RELEASE_SCORES


def merged(spark, albums, vocabulary=EDITION_WORDS):
    df = spark.createDataFrame(albums, "id string, name string, artist_id string, seq long")
    return dict(rows(editions.merge_map(df, vocabulary)))


def greedy(albums):
    """The rule, one album at a time."""
    out = {}
    by_artist = {}
    for album in albums:
        by_artist.setdefault(album[2], []).append(album)
    for group in by_artist.values():
        before = []
        for album in sorted(group, key=lambda a: (-len(a[1]), a[3])):
            for other in before:
                long, short = other[1].lower(), album[1].lower()
                left = re.findall(r"[^\W\d_]+", long.replace(short, "", 1))
                if other[0] not in out and short in long and all(w in EDITION_WORDS for w in left):
                    out[album[0]] = other[0]
                    break
            before.append(album)
    return out


PIECES = ["abba", "live", " ", " (deluxe", "edition)", "part", "ition", "1", "2", "22", "vol.", "Deluxe", "ed",
          "track", "tracks", "s", "long", "-", "X", "Édition", "İ"]
STEMS = ["Live", "Abba", "", "X Part", "partition", "1989"]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_the_greedy_rule(spark, seed):
    rnd = random.Random(seed)

    def name():
        front = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 2)))
        return front + rnd.choice(STEMS) + "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 4)))

    albums = [(f"i{i}", name(), rnd.choice(["a", "b", "c", None]), i) for i in range(1200)]
    expected = greedy(albums)
    assert len(expected) > 100
    got = merged(spark, albums)
    assert got == expected
    assert not set(got.values()) & set(got)


def test_a_chain_joins_its_longest_name(spark):
    # The short names join the longest, not the middle one, which is merged itself.
    albums = [("1", "ab long edition", "a", 1), ("2", "ab long", "a", 2), ("3", "ab", "a", 3),
              ("4", "b live 2", "a", 4), ("5", "b live", "a", 5), ("6", "b", "a", 6)]
    assert merged(spark, albums) == greedy(albums) == {"2": "1", "3": "1", "5": "4"}


def test_merge_needs_several_rounds(spark):
    # "ed" fits only "ed long", as its first place in the longest name leaves "ition"
    # behind; that one is merged, so "ed" stays.
    albums = [("1", "edition ed long", "a", 1), ("2", "ed long", "a", 2), ("3", "ed", "a", 3)]
    assert merged(spark, albums) == greedy(albums) == {"2": "1"}


def test_digits_and_volume_words_merge_and_other_words_do_not(spark):
    albums = [("1", "Hits Vol. 2", "a", 1), ("2", "Hits", "a", 2), ("3", "Hits 2", "a", 3), ("4", "Hits Live", "a", 4),
              ("5", "Hits", "b", 5), ("6", "Hits", "c", 6), ("7", "Hits 2", "c", 7)]
    # "Hits 2" is no part of "Hits Vol. 2", and another artist's "Hits" is another album.
    assert merged(spark, albums) == greedy(albums) == {"2": "1", "6": "7"}


def test_vocabulary_is_an_argument(spark):
    albums = [("1", "Red (Taylors Version)", "a", 1), ("2", "Red", "a", 2)]
    assert merged(spark, albums) == {}
    assert merged(spark, albums, EDITION_WORDS_V3) == {"2": "1"}


def test_one_artist_with_very_many_albums_of_one_name(spark):
    albums = [(f"i{i:05d}", "Best" if i % 3 else f"Best {i}", "various", i) for i in range(6000)]
    got = merged(spark, albums)
    # "Best" goes to the first of the longest names, names like "Best 12" to one that holds them.
    assert got == greedy(albums)


def test_repointing_keeps_tracks_and_drops_merged_albums(spark):
    albums = spark.createDataFrame([("1", "X Deluxe"), ("2", "X"), ("3", "Y")], "id string, name string")
    merges = spark.createDataFrame([("2", "1")], "album_id string, master_id string")
    tracks = spark.createDataFrame([("t", "2"), ("u", "3"), ("v", None)], "isrc string, album_id string")
    assert sorted(rows(editions.repoint_tracks(tracks, merges)), key=str) == [("t", "1"), ("u", "3"), ("v", None)]
    assert sorted(rows(editions.surviving_albums(albums, merges))) == [("1", "X Deluxe"), ("3", "Y")]


def test_best_release_equals_a_loop(spark):
    rnd = random.Random(5)
    kinds = ["album", "compilation", "single", "ep", None]
    candidates = [(f"c{rnd.randint(0, 60)}", rnd.choice(kinds), rnd.randint(1, 4), i) for i in range(2000)]
    best, first = {}, {}
    for isrc, kind, n, seq in candidates:
        score = RELEASE_SCORES.get(kind, 0)
        first.setdefault(isrc, seq)
        if isrc not in best or (score, n) > best[isrc][0]:
            best[isrc] = ((score, n), seq)
    df = spark.createDataFrame(candidates, "isrc string, album_type string, total_tracks long, seq long")
    got = {r["isrc"]: (r["seq"], r["first_seq"]) for r in releases.best_release(df).collect()}
    assert got == {isrc: (kept[1], first[isrc]) for isrc, kept in best.items()}


def test_insert_or_ignore_twice_is_once(spark):
    schema = "id string, name string, seq long"
    stored = spark.createDataFrame([("a", "old", 0)], schema)
    incoming = spark.createDataFrame(
        [("a", "new", 1), ("b", None, 1), ("b", "late", 3), ("b", "early", 2), (None, "x", 1)], schema
    )
    once = releases.insert_or_ignore(stored, incoming, ["id"], ["name"], "seq")
    twice = releases.insert_or_ignore(once, incoming, ["id"], ["name"], "seq")
    assert sorted(rows(once)) == sorted(rows(twice)) == [("a", "old", 0), ("b", "early", 2)]


def test_upgrade_needs_a_strictly_better_type(spark):
    winners = spark.createDataFrame([("t1", "album"), ("t2", "album"), ("t3", "single"), ("t4", "ep")],
                                    "isrc string, album_type string")
    known = spark.createDataFrame([("t1", "single"), ("t2", "album"), ("t3", None)], "isrc string, album_type string")
    got = rows(releases.upgrades_only(winners, known), "isrc", "is_upgrade")
    assert sorted(got) == [("t1", True), ("t3", True), ("t4", False)]


@pytest.mark.parametrize("ms, shown", [
    (0, "0h 00m"), (59999, "0h 00m"), (60000, "0h 01m"), (3599999, "0h 59m"), (3600000, "1h 00m"),
    (360000000, "100h 00m"), (2 * 10**17 + 61000, "55555555555h 34m"), (None, "0h 00m"),
])
def test_listening_time(spark, ms, shown):
    df = spark.createDataFrame([(ms,)], "ms long")
    assert df.select(text.listening_time(F.col("ms"))).first()[0] == shown


@pytest.mark.parametrize("name", ["abc", "Été 2", "a_b", "x²y", "Ⅳ ab", "a1b2", "", "日本 語"])
def test_words_are_runs_of_letters(spark, name):
    got = spark.createDataFrame([(name,)], "n string").select(text.words(F.col("n"))).first()[0]
    assert got == re.findall(r"[^\W\d_]+", name)


@pytest.mark.parametrize("longer, part, left", [
    ("abcabc", "b", "acabc"), ("abc", "", "abc"), ("abc", "abc", ""), ("abc", "z", "abc"), ("éaé", "é", "aé"),
])
def test_remove_first(spark, longer, part, left):
    df = spark.createDataFrame([(longer, part)], "a string, b string")
    assert df.select(text.remove_first(F.col("a"), F.col("b"))).first()[0] == left


def test_metadata_scalars(spark):
    one = spark.range(1)
    assert one.select(text.uri_to_id(F.lit("spotify:track:x1"))).first()[0] == "x1"
    assert one.select(text.uri_to_id(F.lit(None).cast("string"))).first()[0] is None
    assert one.select(media.release_score(F.lit("unknown"))).first()[0] == 0
    assert one.select(media.release_score(F.lit(None).cast("string"))).first()[0] == 0
    people = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one.select(media.featured_artists(people)).first()[0] == ["b", "c"]
    assert one.select(media.featured_artists(F.array(F.lit("a")))).first()[0] == []
    nobody = F.array().cast("array<string>")
    assert one.select(media.main_artist(nobody), F.size(media.featured_artists(nobody))).first()[:] == (None, 0)
    assert one.select(text.artist_list(F.lit("a, b"))).first()[0] == ["a", "b"]
    assert one.select(text.artist_list(F.lit(None).cast("string"))).first()[0] == []
