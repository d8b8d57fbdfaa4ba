"""Import of exports into a lake: resolve, choose releases, add plays, merge editions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.lake import Lake
from listenlake.operators.editions import merge_map, repoint_tracks, surviving_albums
from listenlake.operators.filters import drop_unkeyed
from listenlake.operators.releases import (
    add_winners, best_release, catalog_album_types, insert_or_ignore, upgrade_release, upgrades_only,
)
from listenlake.schemas import EDITION_WORDS, SOURCE_A, SOURCE_B
from listenlake.session import cut_lineage
from listenlake.sources.metadata import candidates_by_id, candidates_by_isrc
from listenlake.sources.store import LakeStore, VersionTaken


def first_seen(history: DataFrame, key: str, batch: int = 0) -> DataFrame:
    """(key, seq): each key once, with its first arrival."""
    return drop_unkeyed(history, key).groupBy(key).agg(F.min("arrival").alias("a")).select(
        key,
        F.struct(
            F.lit(batch).cast("long").alias("batch"),
            F.col("a.file").alias("file"),
            F.col("a.pos").cast("long").alias("pos"),
            F.lit(0).cast("long").alias("item"),
        ).alias("seq"),
    )


def unresolved_ids(history: DataFrame, tracks: DataFrame, batch: int = 0) -> DataFrame:
    """Platform ids of a history that no stored track has."""
    return first_seen(history, "spotify_id", batch).join(
        drop_unkeyed(tracks.select("spotify_id"), "spotify_id"), "spotify_id", "left_anti"
    )


def isrcs_to_resolve(history: DataFrame, known: DataFrame, batch: int = 0) -> DataFrame:
    """Codes of a history that are new or whose stored release is no album."""
    return first_seen(history, "isrc", batch).join(
        known.withColumn("is_known", F.lit(True)), "isrc", "left"
    ).filter(
        F.col("is_known").isNull() | ~F.col("album_type").eqNullSafe("album")
    ).select("isrc", "seq")


def tag_source(plays: DataFrame, source: str) -> DataFrame:
    return plays.withColumn("source", F.lit(source))


def to_plays(history: DataFrame, isrc: Column, source: str) -> DataFrame:
    """History rows in the shape of the play table."""
    return tag_source(history, source).select(
        "library", isrc.alias("track_isrc"),
        F.try_to_date("date").alias("played_at_date"), F.col("time").alias("played_at_time"),
        "ms_played", "source",
    )


def resolve_plays(history: DataFrame, aliases: DataFrame) -> DataFrame:
    """Platform A plays with their recording code; unknown ids keep a null code."""
    known = aliases.select(F.col("platform_id").alias("spotify_id"), "isrc")
    keyed = drop_unkeyed(history, "spotify_id").join(known, "spotify_id", "left")
    return to_plays(keyed, F.col("isrc"), SOURCE_A)


def valid_plays(history: DataFrame, tracks: DataFrame) -> DataFrame:
    """Platform B plays whose code is in the catalog."""
    keyed = drop_unkeyed(history, "isrc").join(tracks.select("isrc"), "isrc", "left_semi")
    return to_plays(keyed, F.col("isrc"), SOURCE_B)


def known_aliases(lake: Lake, candidates: DataFrame | None = None) -> DataFrame:
    """(platform_id, isrc) from earlier imports, stored tracks and this run's lookups."""
    pair = [F.col("spotify_id").alias("platform_id"), F.col("isrc")]
    stored = lake.tracks.select(*pair)
    if lake.track_aliases is not None:
        stored = insert_or_ignore(lake.track_aliases, stored, ["platform_id"], order="isrc")
    else:
        stored = stored.dropna().groupBy("platform_id").agg(F.min("isrc").alias("isrc"))
    if candidates is None:
        return stored
    return insert_or_ignore(stored, candidates.select(*pair), ["platform_id"], order="isrc")


def import_a(lake: Lake, history: DataFrame, metadata: DataFrame, batch: int = 0) -> Lake:
    """Add platform A: stored releases stay, new codes get their best release."""
    candidates = cut_lineage(candidates_by_id(unresolved_ids(history, lake.tracks, batch), metadata))
    aliases = known_aliases(lake, candidates)
    lake = add_winners(lake, cut_lineage(best_release(candidates)))
    return lake.with_tables(
        track_aliases=aliases, plays=lake.plays.unionByName(resolve_plays(history, aliases))
    )


def import_b(lake: Lake, history: DataFrame, metadata: DataFrame, batch: int = 0) -> Lake:
    """Add platform B: stored releases give way to strictly better ones."""
    known = catalog_album_types(lake)
    wanted = isrcs_to_resolve(history, known, batch)
    # Results come in search order, so that order decides between equals.
    candidates = candidates_by_isrc(wanted, metadata).withColumns({
        "code_seq": F.col("seq"), "seq": F.struct("search_rank", "spotify_id"),
    })
    winners = best_release(candidates).drop("first_seq").withColumnRenamed("code_seq", "first_seq")
    lake = upgrade_release(lake, cut_lineage(upgrades_only(winners, known)))
    return lake.with_tables(plays=lake.plays.unionByName(valid_plays(history, lake.tracks)))


def merge_editions(lake: Lake, vocabulary: Sequence[str] = EDITION_WORDS) -> Lake:
    """Fold album editions into their longest version."""
    albums = cut_lineage(lake.albums)
    merges = cut_lineage(merge_map(albums, vocabulary))
    return lake.with_tables(
        albums=surviving_albums(albums, merges), tracks=repoint_tracks(lake.tracks, merges)
    )


def blend_exports(lake: Lake, history_a: DataFrame | None, history_b: DataFrame | None,
                  metadata: DataFrame, batch: int = 0,
                  vocabulary: Sequence[str] = EDITION_WORDS) -> Lake:
    """Both platforms into one lake: A, then B, then the edition merge.

    Everything from B arrives after everything from A.
    """
    if history_a is not None:
        lake = import_a(lake, history_a, metadata, 2 * batch)
    if history_b is not None:
        lake = import_b(lake, history_b, metadata, 2 * batch + 1)
    return merge_editions(lake, vocabulary)


def import_library(store: LakeStore, batch: str, history_a: DataFrame | None, history_b: DataFrame | None,
                   metadata: DataFrame, dedupe: bool = False,
                   vocabulary: Sequence[str] = EDITION_WORDS, library: str | None = None, tries: int = 5) -> Lake:
    """The import job, also for more exports into a lake that has some.

    `batch` names the import, and with `library` that listener's import of the name: a finished one is not
    repeated, and one that broke off is written over when it runs again.  Plays and catalog are listed
    together.  If another import finishes meanwhile, this one starts again on its catalog.
    """
    key = batch if library is None else f"{library}/{batch}"
    for left in reversed(range(tries)):
        version = store.version()
        if version is None:
            lake, number = store.empty(), 0
        elif store.finished(key):
            return store.read()
        else:
            # Plays of earlier imports stay where they are; only the new ones are written.
            lake, number = store.read().with_tables(plays=store.empty().plays), version + 1
        blended = blend_exports(lake, history_a, history_b, metadata, number, vocabulary)
        attempt = store.append_plays(blended.plays, key, dedupe, commit=False)
        try:
            store.write_catalog(blended, key, attempt, version)
            return store.read()
        except VersionTaken:
            if not left:
                raise
    raise ValueError("an import needs at least one try")
