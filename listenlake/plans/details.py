"""Composite reports as one frame each: a `section` column tells the parts apart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F, types as T

from listenlake.functions.text import listening_time
from listenlake.lake import Lake
from listenlake.operators.filters import preset_range
from listenlake.operators.rollup import detail_stats
from listenlake.operators.topk import metric, with_rank
from listenlake.plans import reports, search
from listenlake.session import cut_lineage

SECTIONS = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("album", T.StringType()),
    T.StructField("total_ms", T.LongType()),
    T.StructField("play_count", T.LongType()),
    T.StructField("listening_time", T.StringType()),
    T.StructField("first_listen", T.StringType()),
    T.StructField("unique_tracks", T.LongType()),
])


def _section(df: DataFrame, section: str) -> DataFrame:
    """Fit a part to the common columns; missing ones are null."""
    if "listening_time" not in df.columns:
        df = df.withColumn("listening_time", listening_time(F.col("total_ms")))
    df = df.withColumn("section", F.lit(section))
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SECTIONS.fields
    ])


def _stack(parts: list[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def find_id(table: DataFrame, name: str) -> DataFrame:
    """{id}: the first arrival with exactly this name, null when there is none."""
    return table.filter(F.col("name") == name).agg(F.min_by("id", F.struct("seq", "id")).alias("id"))


def find_artist_id(lake: Lake, name: str) -> DataFrame:
    return find_id(lake.artists, name)


def find_album_id(lake: Lake, name: str) -> DataFrame:
    return find_id(lake.albums, name)


def artist_detail(lake: Lake, name: str, limit: int = 10, param: int = 0,
                  library: str | None = None) -> DataFrame:
    """Stats, top tracks and top albums of the artist with this name; empty when unknown."""
    artist_id = find_artist_id(lake, name).first()["id"]
    if artist_id is None:
        return lake.artists.sparkSession.createDataFrame([], SECTIONS)
    by = metric(param)
    # All three parts need these rows; writing them down keeps it at one scan of plays.
    played = cut_lineage(reports.played_by_artist(lake, artist_id, library=library))
    stats = detail_stats(played).withColumn("name", F.lit(name))
    tracks = with_rank(
        reports.artist_top_tracks_keyed(lake, artist_id, limit, param, played=played), by, ["isrc"], limit
    )
    albums = with_rank(
        reports.artist_top_albums_keyed(lake, artist_id, limit, param, played=played), by, ["album_id"], limit
    )
    return _stack([
        _section(stats.withColumnRenamed("total_plays", "play_count"), "stats"),
        _section(tracks.withColumnRenamed("title", "name"), "tracks"),
        _section(albums.withColumn("name", F.col("album")), "albums"),
    ])


def album_detail(lake: Lake, name: str, limit: int = 50, param: int = 0,
                 library: str | None = None) -> DataFrame:
    """Stats with the album's artist, and top tracks; empty when unknown."""
    album_id = find_album_id(lake, name).first()["id"]
    if album_id is None:
        return lake.albums.sparkSession.createDataFrame([], SECTIONS)
    owner = lake.albums.filter(F.col("id") == album_id).join(
        lake.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("owner")), "artist_id"
    ).agg(F.coalesce(F.max("owner"), F.lit("")))
    played = cut_lineage(reports.played_on_album(lake, album_id, library))
    stats = detail_stats(played).withColumns(
        {"name": F.lit(name), "artist": owner.scalar()}
    )
    tracks = with_rank(
        reports.album_tracks_keyed(lake, album_id, limit, param, played=played), metric(param), ["isrc"], limit
    )
    return _stack([
        _section(stats.withColumnRenamed("total_plays", "play_count"), "stats"),
        _section(tracks.withColumnRenamed("title", "name"), "tracks"),
    ])


def search_all(lake: Lake, query: str, limit: int = 10, library: str | None = None,
               played_only: bool = False) -> DataFrame:
    """Tracks, artists and albums that match, `limit` of each."""
    # All three parts need these rows; writing them down keeps it at one scan of plays.
    played = cut_lineage(search.played_of_found(lake, query, library))
    args = (lake, query, limit, library, played_only, played)
    return _stack([
        _section(with_rank(search.search_tracks_keyed(*args), "play_count", ["isrc"], limit), "tracks"),
        _section(with_rank(search.search_artists_keyed(*args), "play_count", ["artist_id"], limit), "artists"),
        _section(with_rank(search.search_albums_keyed(*args), "play_count", ["album_id"], limit), "albums"),
    ])


def dashboard(lake: Lake, preset: str = "all", param: int = 0, today: dt.date | None = None,
              limit: int = 10, library: str | None = None) -> DataFrame:
    """Totals, top tracks and top artists of a preset range.

    The three parts start from the same per-track totals, so plays are scanned
    and shuffled once and the later parts reuse that exchange.
    """
    start, end = preset_range(preset, today)
    by = metric(param)
    stats = reports.general_stats(lake, start, end, library)
    counters = stats.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("name"), F.col(column).cast("long").alias("play_count"),
                 F.col("listening_time").alias("listening_time"))
        for label, column in [("plays", "total_plays"), ("tracks", "total_tracks"),
                              ("artists", "total_artists"), ("albums", "total_albums")]
    ])))
    tracks = with_rank(
        reports.top_tracks_keyed(lake, limit, param, start, end, library), by, ["isrc"], limit
    )
    artists = with_rank(
        reports.top_artists_keyed(lake, limit, param, start, end, library), by, ["artist_id"], limit
    )
    return _stack([
        _section(counters, "stats"),
        _section(tracks.withColumnRenamed("title", "name"), "tracks"),
        _section(artists, "artists"),
    ])
