"""Search over titles, artists and albums; things never played are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listenlake.functions.text import has_wildcards, listening_time, matches
from listenlake.lake import Lake
from listenlake.operators.credits import all_artists, credit_names, display_names, with_display_names
from listenlake.operators.rollup import rollup, totals
from listenlake.operators.topk import top


def spans_names(query: str) -> bool:
    """Whether `query` may match a display string without matching any one name in it.

    Such a match covers part of a `, ` between two names: it holds the comma,
    or starts at the blank, or reaches across through a wildcard.
    """
    return has_wildcards(query) or "," in query or query.startswith(" ")


def _tracks_by_artist(lake: Lake, query: str) -> DataFrame:
    """(isrc) whose display string matches."""
    if spans_names(query):
        return display_names(lake).filter(matches(F.col("artist"), query)).select("isrc")
    # One name must match by itself, so filter names before any credit moves.
    hits = lake.artists.filter(matches(F.col("name"), query)).select(F.col("id").alias("artist_id"))
    return all_artists(lake).join(hits, "artist_id", "left_semi").select(
        F.col("track_isrc").alias("isrc")
    ).distinct()


def feature_matches(lake: Lake, query: str) -> DataFrame:
    """(isrc) of tracks that feature an artist whose name matches."""
    hits = lake.artists.filter(matches(F.col("name"), query)).select(F.col("id").alias("artist_id"))
    return lake.track_features.join(hits, "artist_id", "left_semi").select(
        F.col("track_isrc").alias("isrc")
    ).distinct()


def _with_plays(found: DataFrame, lake: Lake, key: str, library: str | None, played_only: bool,
                played: DataFrame | None = None) -> DataFrame:
    """`found` with its totals; only plays of what was found are summed, unless `played` has them already."""
    if played is None:
        played = rollup(lake, library=library, only=found.select(F.col(key).alias("track_isrc")).distinct())
    rolled = played.select(
        F.col("track_isrc").alias(key), F.col("total_ms").alias("ms"), F.col("play_count").alias("plays")
    )
    return found.join(rolled, key, "inner" if played_only else "left").select(
        *found.columns,
        F.coalesce("ms", F.lit(0)).alias("total_ms"),
        F.coalesce("plays", F.lit(0)).alias("play_count"),
    )


def found_tracks(lake: Lake, query: str) -> DataFrame:
    """(isrc, name, artist_id) of title, display string or album matches.

    A feature whose name matches is part of the display string, so that test
    is covered by it.
    """
    albums = lake.albums.select(F.col("id").alias("album_id"), F.col("name").alias("album"))
    by_artist = _tracks_by_artist(lake, query).withColumn("by_artist", F.lit(True))
    tracks = lake.tracks.select("isrc", F.col("title").alias("name"), "artist_id", "album_id")
    return (
        tracks.join(albums, "album_id", "left").join(by_artist, "isrc", "left")
        .filter(
            matches(F.col("name"), query)
            | F.coalesce(matches(F.col("album"), query), F.lit(False))
            | F.coalesce("by_artist", F.lit(False))
        )
        .select("isrc", "name", "artist_id")
    )


def found_artists(lake: Lake, query: str) -> DataFrame:
    """(artist_id, name, track_isrc) of the artists that match, with what they are credited on."""
    found = lake.artists.filter(matches(F.col("name"), query)).select(F.col("id").alias("artist_id"), "name")
    return found.join(all_artists(lake), "artist_id", "left")


def search_tracks_keyed(lake: Lake, query: str, limit: int = 10, library: str | None = None,
                        played_only: bool = False, played: DataFrame | None = None) -> DataFrame:
    found = _with_plays(found_tracks(lake, query), lake, "isrc", library, played_only, played)
    return with_display_names(lake, top(found, "play_count", ["isrc"], limit))


def search_artists_keyed(lake: Lake, query: str, limit: int = 10, library: str | None = None,
                         played_only: bool = False, played: DataFrame | None = None) -> DataFrame:
    per_artist = (
        _with_plays(found_artists(lake, query), lake, "track_isrc", library, played_only, played)
        .groupBy("artist_id", "name").agg(*totals())
    )
    return top(per_artist, "play_count", ["artist_id"], limit)


def found_albums(lake: Lake, query: str) -> DataFrame:
    """(album_id, name, artist, track_isrc) of the albums that match, with their tracks."""
    artists = lake.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist"))
    found = (
        lake.albums.select(F.col("id").alias("album_id"), "name", "artist_id")
        .join(artists, "artist_id")
        .filter(matches(F.col("name"), query) | matches(F.col("artist"), query))
        .select("album_id", "name", "artist")
    )
    tracks = lake.tracks.select(F.col("isrc").alias("track_isrc"), "album_id")
    return found.join(tracks, "album_id", "left").select("album_id", "name", "artist", "track_isrc")


def search_albums_keyed(lake: Lake, query: str, limit: int = 10, library: str | None = None,
                        played_only: bool = False, played: DataFrame | None = None) -> DataFrame:
    per_album = (
        _with_plays(found_albums(lake, query), lake, "track_isrc", library, played_only, played)
        .groupBy("album_id", "name", "artist").agg(*totals())
    )
    return top(per_album, "play_count", ["album_id"], limit)


def played_of_found(lake: Lake, query: str, library: str | None = None) -> DataFrame:
    """Per-track totals of everything the three searches find, in one pass over plays."""
    found = found_tracks(lake, query).select(F.col("isrc").alias("track_isrc")).unionByName(
        found_artists(lake, query).select("track_isrc")).unionByName(found_albums(lake, query).select("track_isrc"))
    return rollup(lake, library=library, only=found.distinct())


def _finish(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("listening_time", listening_time(F.col("total_ms"))).select(
        *columns, "total_ms", "play_count", "listening_time"
    )


def search_tracks(lake: Lake, query: str, limit: int = 10, library: str | None = None,
                  played_only: bool = False) -> DataFrame:
    """{name, artist, total_ms, play_count, listening_time}, most played first."""
    found = search_tracks_keyed(lake, query, limit, library, played_only)
    return _finish(found.orderBy(F.desc("play_count"), "isrc"), ["name", "artist"])


def search_artists(lake: Lake, query: str, limit: int = 10, library: str | None = None,
                   played_only: bool = False) -> DataFrame:
    """{name, total_ms, play_count, listening_time}; plays as a featured artist count."""
    return _finish(search_artists_keyed(lake, query, limit, library, played_only), ["name"])


def search_albums(lake: Lake, query: str, limit: int = 10, library: str | None = None,
                  played_only: bool = False) -> DataFrame:
    """{name, artist, …} by album name or album-artist name."""
    return _finish(search_albums_keyed(lake, query, limit, library, played_only), ["name", "artist"])
