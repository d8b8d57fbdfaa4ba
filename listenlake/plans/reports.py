"""Totals and top lists over an optional date range.

Common arguments: `limit` (negative keeps all rows), `param` (1 orders by
plays, anything else by time), `start` and `end` (inclusive dates), `library`
(None takes all plays as one history), `per_library` (one list per library).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listenlake.functions.text import listening_time
from listenlake.lake import Lake
from listenlake.operators.credits import (
    all_artists, number_artists, per_library_artist, tracks_of_artist, with_display_names,
)
from listenlake.operators.rollup import detail_stats, rollup, totals, track_count
from listenlake.operators.topk import metric, top


def _finish(df: DataFrame, columns: list[str], per_library: bool = False) -> DataFrame:
    lead = ["library"] if per_library else []
    return df.withColumn("listening_time", listening_time(F.col("total_ms"))).select(
        *lead, *columns, "total_ms", "play_count", "listening_time"
    )


def _ordered(df: DataFrame, by: str, keys: list[str], per_library: bool) -> DataFrame:
    """Put the list back in order after the name joins; it is short by now."""
    return df.orderBy(*(["library"] if per_library else []), F.desc(by), *keys)


def general_stats(lake: Lake, start=None, end=None, library: str | None = None,
                  per_library: bool = False) -> DataFrame:
    """Time, plays, and distinct tracks, main artists and albums.

    Plays without a recording code add to the time only.  One scan: the
    distinct counts run over per-track rows, not over plays.
    """
    rolled = rollup(lake, start, end, library, per_library)
    tracks = lake.tracks.select(F.col("isrc").alias("track_isrc"), "artist_id", "album_id")
    artists = lake.artists.select(F.col("id").alias("known_artist"))
    joined = rolled.join(tracks, "track_isrc", "left").join(
        artists, F.col("artist_id") == F.col("known_artist"), "left"
    )
    grouped = joined.groupBy("library") if per_library else joined.groupBy()
    stats = grouped.agg(
        *totals(),
        track_count().alias("total_tracks"),
        F.count_distinct("known_artist").alias("total_artists"),
        F.count_distinct("album_id").alias("total_albums"),
    )
    return stats.select(
        *(["library"] if per_library else []),
        listening_time(F.col("total_ms")).alias("listening_time"),
        F.col("play_count").alias("total_plays"),
        "total_tracks", "total_artists", "total_albums",
    )


def top_tracks_keyed(lake: Lake, limit: int = 10, param: int = 0, start=None, end=None,
                     library: str | None = None, per_library: bool = False,
                     artist_display: str = "all", sums=None) -> DataFrame:
    """`top_tracks` with the keys still on it, unordered; with `sums` (`operators.sums.Sums`) totals come from them, not from plays."""
    tracks = lake.tracks.select("isrc", "title", "artist_id")
    if artist_display == "main":
        tracks = tracks.join(lake.artists.select(F.col("id").alias("artist_id")), "artist_id", "left_semi")
    rolled = (sums.rollup(start, end, library, per_library) if sums is not None else rollup(lake, start, end, library, per_library))
    rolled = rolled.drop("first_listen").withColumnRenamed(
        "track_isrc", "isrc"
    )
    ranked = top(rolled.join(tracks, "isrc"), metric(param), ["isrc"], limit, per_library)
    return with_display_names(lake, ranked, artist_display, repeated=per_library)


def top_tracks(lake: Lake, limit: int = 10, param: int = 0, start=None, end=None,
               library: str | None = None, per_library: bool = False,
               artist_display: str = "all", sums=None) -> DataFrame:
    """{title, artist, total_ms, play_count, listening_time} per recording."""
    named = top_tracks_keyed(lake, limit, param, start, end, library, per_library, artist_display, sums)
    named = _ordered(named, metric(param), ["isrc"], per_library)
    return _finish(named, ["title", "artist"], per_library)


def top_artists_keyed(lake: Lake, limit: int = 10, param: int = 0, start=None, end=None,
                      library: str | None = None, per_library: bool = False) -> DataFrame:
    names = lake.artists.select(F.col("id").alias("artist_id"), "name")
    rolled = rollup(lake, start, end, library, per_library)
    if per_library:
        # Numbers follow the ids, so lists are cut by them; only what is left is named.  A second cut, as an id may have two names.
        numbers = number_artists(names.dropna(subset=["artist_id"]))
        summed = per_library_artist(lake, rolled, numbers, by=metric(param), limit=limit)
        ranked = top(summed, metric(param), ["artist_no"], limit, per_library)
        named = ranked.join(numbers, "artist_no").drop("artist_no").join(names, "artist_id")
    else:
        named = rolled.join(all_artists(lake), "track_isrc").groupBy("artist_id").agg(*totals()).join(names, "artist_id")
    return top(named, metric(param), ["artist_id"], limit, per_library)


def top_artists(lake: Lake, limit: int = 10, param: int = 0, start=None, end=None,
                library: str | None = None, per_library: bool = False) -> DataFrame:
    """{name, total_ms, play_count, listening_time}; featured artists get full credit."""
    ranked = top_artists_keyed(lake, limit, param, start, end, library, per_library)
    if per_library:
        ranked = _ordered(ranked, metric(param), ["artist_id"], per_library)
    return _finish(ranked, ["name"], per_library)


def top_albums_keyed(lake: Lake, limit: int = 10, param: int = 0, start=None, end=None,
                     library: str | None = None, per_library: bool = False) -> DataFrame:
    lead = ["library"] if per_library else []
    tracks = lake.tracks.select(F.col("isrc").alias("track_isrc"), "album_id")
    per_album = (
        rollup(lake, start, end, library, per_library)
        .join(tracks, "track_isrc")
        .groupBy(*lead, "album_id").agg(*totals())
    )
    albums = lake.albums.select(F.col("id").alias("album_id"), F.col("name").alias("album"), "artist_id")
    artists = lake.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist"))
    named = per_album.join(albums, "album_id").join(artists, "artist_id")
    return top(named, metric(param), ["album_id"], limit, per_library)


def top_albums(lake: Lake, limit: int = 10, param: int = 0, start=None, end=None,
               library: str | None = None, per_library: bool = False) -> DataFrame:
    """{album, artist, total_ms, play_count, listening_time}; the artist is the album's."""
    ranked = top_albums_keyed(lake, limit, param, start, end, library, per_library)
    if per_library:
        ranked = _ordered(ranked, metric(param), ["album_id"], per_library)
    return _finish(ranked, ["album", "artist"], per_library)


def played_by_artist(lake: Lake, artist_id: str, start=None, end=None, library: str | None = None) -> DataFrame:
    """Per-track totals of the tracks the artist is credited on."""
    return rollup(lake, start, end, library, only=tracks_of_artist(lake, artist_id))


def played_on_album(lake: Lake, album_id: str, library: str | None = None) -> DataFrame:
    """Per-track totals of the tracks on the album."""
    own = lake.tracks.filter(F.col("album_id") == album_id).select(F.col("isrc").alias("track_isrc"))
    return rollup(lake, library=library, only=own)


def artist_top_tracks_keyed(lake: Lake, artist_id: str, limit: int = 10, param: int = 0, start=None,
                            end=None, library: str | None = None, artist_display: str = "all",
                            played: DataFrame | None = None) -> DataFrame:
    if played is None:
        played = played_by_artist(lake, artist_id, start, end, library)
    tracks = lake.tracks.select(F.col("isrc").alias("track_isrc"), "title", "artist_id", "album_id")
    albums = lake.albums.select(F.col("id").alias("album_id"), F.col("name").alias("album"))
    listed = (
        played.drop("first_listen").join(tracks, "track_isrc").join(albums, "album_id")
        .withColumnRenamed("track_isrc", "isrc")
    )
    ranked = top(listed, metric(param), ["isrc"], limit)
    if artist_display == "asked":
        asked = lake.artists.filter(F.col("id") == artist_id).agg(F.max("name"))
        return ranked.withColumn("artist", asked.scalar())
    return with_display_names(lake, ranked)


def artist_top_tracks(lake: Lake, artist_id: str, limit: int = 10, param: int = 0, start=None, end=None,
                      library: str | None = None, artist_display: str = "all") -> DataFrame:
    """{title, album, artist, …} of tracks the artist is credited on; tracks without an album drop."""
    named = artist_top_tracks_keyed(lake, artist_id, limit, param, start, end, library, artist_display)
    return _finish(named.orderBy(F.desc(metric(param)), "isrc"), ["title", "album", "artist"])


def artist_top_albums_keyed(lake: Lake, artist_id: str, limit: int = 10, param: int = 0,
                            library: str | None = None, played: DataFrame | None = None) -> DataFrame:
    if played is None:
        played = played_by_artist(lake, artist_id, library=library)
    tracks = lake.tracks.select(F.col("isrc").alias("track_isrc"), "album_id")
    per_album = played.join(tracks, "track_isrc").groupBy("album_id").agg(*totals())
    albums = lake.albums.select(F.col("id").alias("album_id"), F.col("name").alias("album"))
    asked = lake.artists.filter(F.col("id") == artist_id).agg(F.max("name"))
    named = per_album.join(albums, "album_id").withColumn("artist", asked.scalar()).dropna(subset=["artist"])
    return top(named, metric(param), ["album_id"], limit)


def artist_top_albums(lake: Lake, artist_id: str, limit: int = 10, param: int = 0,
                      library: str | None = None) -> DataFrame:
    """{album, artist, …} counting only the artist's own tracks; `artist` is the asked one."""
    return _finish(artist_top_albums_keyed(lake, artist_id, limit, param, library), ["album", "artist"])


def album_tracks_keyed(lake: Lake, album_id: str, limit: int = 10, param: int = 0,
                       library: str | None = None, played: DataFrame | None = None) -> DataFrame:
    if played is None:
        played = played_on_album(lake, album_id, library)
    tracks = lake.tracks.filter(F.col("album_id") == album_id).select(
        F.col("isrc").alias("track_isrc"), "title", "artist_id", "album_id"
    )
    albums = lake.albums.filter(F.col("id") == album_id).select(
        F.col("id").alias("album_id"), F.col("name").alias("album")
    )
    listed = (
        played.drop("first_listen").join(tracks, "track_isrc").join(albums, "album_id")
        .withColumnRenamed("track_isrc", "isrc")
    )
    return with_display_names(lake, top(listed, metric(param), ["isrc"], limit))


def album_tracks(lake: Lake, album_id: str, limit: int = 10, param: int = 0,
                 library: str | None = None) -> DataFrame:
    """{title, album, artist, …} of one album."""
    named = album_tracks_keyed(lake, album_id, limit, param, library)
    return _finish(named.orderBy(F.desc(metric(param)), "isrc"), ["title", "album", "artist"])


def artist_stats(lake: Lake, artist_id: str, library: str | None = None) -> DataFrame:
    """{total_plays, total_ms, listening_time, unique_tracks, first_listen}, features included."""
    return detail_stats(played_by_artist(lake, artist_id, library=library))


def album_stats(lake: Lake, album_id: str, library: str | None = None) -> DataFrame:
    """The same columns for one album."""
    return detail_stats(played_on_album(lake, album_id, library))
