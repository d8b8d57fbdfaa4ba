"""Choosing the canonical release of a recording and adding it to the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.functions.media import featured_artists, main_artist, release_score
from listenlake.functions.text import url_to_id
from listenlake.lake import Lake


def flatten_metadata(metadata: DataFrame) -> DataFrame:
    """One flat row per track object; rows without a recording code drop."""
    isrc = F.col("external_ids.isrc")
    return metadata.filter(isrc != "").select(
        isrc.alias("isrc"),
        F.col("id").alias("requested_id"),
        url_to_id(F.col("external_urls.spotify")).alias("spotify_id"),
        F.col("name").alias("title"),
        "duration_ms",
        F.col("album.id").alias("album_id"),
        F.col("album.name").alias("album_name"),
        F.col("album.album_type").alias("album_type"),
        F.col("album.total_tracks").alias("total_tracks"),
        main_artist(F.col("artists"))["id"].alias("artist_id"),
        "artists",
        "search_rank",
    )


def preference(album_type: Column, total_tracks: Column, seq: Column) -> Column:
    """Sorts the best release first: type, then track count, then first seen."""
    return F.struct(
        (-release_score(album_type)).alias("score"),
        (-F.coalesce(total_tracks, F.lit(-1))).alias("tracks"),
        seq.alias("seq"),
    )


def best_release(candidates: DataFrame) -> DataFrame:
    """The best candidate per `isrc`, with `first_seq`, when the code was first seen.

    An aggregate rather than a window: map tasks keep one candidate per code,
    so a code with very many candidates does not end up in one task.
    """
    rest = [c for c in candidates.columns if c != "isrc"]
    order = preference(F.col("album_type"), F.col("total_tracks"), F.col("seq"))
    best = candidates.groupBy("isrc").agg(
        F.min_by(F.struct(*rest), order).alias("best"), F.min("seq").alias("first_seq")
    )
    return best.select("isrc", "best.*", "first_seq")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, key: Sequence[str],
                     required: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Add rows whose key is new: the stored row wins, then the first by `order`.

    Rows with a null in `key` or `required` are skipped.  Without `order`
    incoming rows with one key must be alike.
    """
    usable = incoming.dropna(subset=[*key, *required])
    rest = [c for c in stored.columns if c not in key]
    if rest:
        first = F.min_by(F.struct(*rest), order) if order else F.first(F.struct(*rest))
        usable = usable.groupBy(*key).agg(first.alias("row")).select(*key, "row.*")
    else:
        usable = usable.select(*key).distinct()
    fresh = usable.join(stored.select(*key), list(key), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def explode_features(tracks: DataFrame) -> DataFrame:
    """(track_isrc, artist_id) for every credit after the first."""
    return tracks.select(
        F.col("isrc").alias("track_isrc"), F.explode(featured_artists(F.col("artists"))).alias("featured")
    ).select("track_isrc", F.col("featured.id").alias("artist_id"))


def _artist_rows(winners: DataFrame, credits: Column) -> DataFrame:
    return winners.select("first_seq", F.posexplode(credits).alias("item", "credit")).select(
        F.col("credit.id").alias("id"),
        F.col("credit.name").alias("name"),
        F.col("first_seq").withField("item", F.col("item").cast("long")).alias("seq"),
    )


def _album_rows(winners: DataFrame) -> DataFrame:
    return winners.select(
        F.col("album_id").alias("id"), F.col("album_name").alias("name"), "artist_id", "album_type",
        F.col("first_seq").alias("seq"),
    )


def add_winners(lake: Lake, winners: DataFrame) -> Lake:
    """Insert each winner's artists, album, track and features where they are new.

    An album belongs to the main artist of the first winner that names it.
    """
    return lake.with_tables(
        artists=insert_or_ignore(
            lake.artists, _artist_rows(winners, F.col("artists")), ["id"], ["name"], "seq"
        ),
        albums=insert_or_ignore(lake.albums, _album_rows(winners), ["id"], ["name"], "seq"),
        tracks=insert_or_ignore(lake.tracks, winners, ["isrc"], ["title"], "first_seq"),
        track_features=insert_or_ignore(
            lake.track_features, explode_features(winners), ["track_isrc", "artist_id"]
        ),
    )


def catalog_album_types(lake: Lake) -> DataFrame:
    """(isrc, album_type) of stored tracks that have an album."""
    albums = lake.albums.select(F.col("id").alias("album_id"), "album_type")
    return lake.tracks.select("isrc", "album_id").join(albums, "album_id").select("isrc", "album_type")


def upgrades_only(winners: DataFrame, known: DataFrame) -> DataFrame:
    """Winners that are new, or strictly better by type than the stored release.

    Adds `is_upgrade`.  Track counts are not compared here.
    """
    stored = known.select("isrc", F.lit(True).alias("is_known"), F.col("album_type").alias("old_type"))
    better = release_score(F.col("album_type")) > release_score(F.col("old_type"))
    return (
        winners.join(stored, "isrc", "left")
        .withColumn("is_upgrade", F.col("is_known").isNotNull())
        .filter(~F.col("is_upgrade") | better)
        .drop("is_known", "old_type")
    )


def upgrade_release(lake: Lake, winners: DataFrame) -> Lake:
    """Apply `upgrades_only` rows.

    An upgrade moves a stored track to the better release and leaves its
    artist and features alone; a new code is inserted with everything.
    """
    upgrades = winners.filter("is_upgrade")
    new = winners.filter("NOT is_upgrade")
    credits = F.when(F.col("is_upgrade"), F.slice("artists", 1, 1)).otherwise(F.col("artists"))
    changed = upgrades.select(
        "isrc", F.lit(True).alias("changed"),
        *[F.col(c).alias(f"new_{c}") for c in ("title", "album_id", "duration_ms", "spotify_id")],
    )
    moved = lake.tracks.join(changed, "isrc", "left").select(*[
        F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        if f"new_{c}" in changed.columns else F.col(c)
        for c in lake.tracks.columns
    ])
    return lake.with_tables(
        artists=insert_or_ignore(lake.artists, _artist_rows(winners, credits), ["id"], ["name"], "seq"),
        albums=insert_or_ignore(lake.albums, _album_rows(winners), ["id"], ["name"], "seq"),
        tracks=insert_or_ignore(moved, new, ["isrc"], ["title"], "first_seq"),
        track_features=insert_or_ignore(
            lake.track_features, explode_features(new), ["track_isrc", "artist_id"]
        ),
    )
