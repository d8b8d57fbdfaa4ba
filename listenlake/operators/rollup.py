"""The one pass over plays that every report starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.functions.text import listening_time
from listenlake.lake import Lake
from listenlake.operators.filters import in_range, of_library


# Key of the plays that have no recording code.
UNRESOLVED = ""


def per_track(plays: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, track_isrc, total_ms, play_count, first_listen).

    Plays are summed inside each map task before any shuffle, so a recording
    that holds a third of all plays moves as one row per task.  Catalog joins
    come after this and never see single plays.

    Plays without a code share the key UNRESOLVED.  As the key is never null,
    Spark pushes no null filter below this, and reports built from the same
    totals stay one scan and one exchange.
    """
    return plays.groupBy(*by, F.coalesce("track_isrc", F.lit(UNRESOLVED)).alias("track_isrc")).agg(
        F.coalesce(F.sum("ms_played"), F.lit(0)).alias("total_ms"),
        F.count("track_isrc").alias("play_count"),
        F.min("played_at_date").alias("first_listen"),
    )


def rollup(lake: Lake, start=None, end=None, library: str | None = None, per_library: bool = False,
           only: DataFrame | None = None) -> DataFrame:
    """Per-track totals of the selected plays.

    `only` (track_isrc) keeps the plays of these recordings, before anything is summed: a page on
    one artist then shuffles that artist's plays alone.
    """
    plays = in_range(of_library(lake.plays, library, lake.buckets), start, end)
    if only is not None:
        plays = plays.join(only.select("track_isrc"), "track_isrc", "left_semi")
    return per_track(plays, ["library"] if per_library else [])


def count_entities(rows: DataFrame, group: str, columns: dict[str, str], tasks: int) -> DataFrame:
    """Per `group`, the number of distinct values of each of `columns` (name in the result: column; one type); nulls do not count.

    Every value is a row of its own and copies are dropped in `tasks` tasks, so what a task holds depends on its rows
    alone; several distinct counts side by side hold every row once for each count.
    """
    kinds = list(columns)
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(columns[c]).alias("_value")) for k, c in enumerate(kinds)]))
    parts = rows.select(group, value.alias("_part")).select(group, "_part.*")
    distinct = parts.repartition(tasks, group, "_kind", "_value").distinct()
    return distinct.groupBy(group).agg(*[
        F.count_if((F.col("_kind") == k) & F.col("_value").isNotNull()).alias(name) for k, name in enumerate(kinds)
    ])


def track_count() -> Column:
    """Number of recordings in per-track rows."""
    return F.count_if(F.col("track_isrc") != UNRESOLVED)


def totals() -> list[Column]:
    """Sum per-track totals further up, to an artist or album."""
    return [
        F.coalesce(F.sum("total_ms"), F.lit(0)).alias("total_ms"),
        F.coalesce(F.sum("play_count"), F.lit(0)).alias("play_count"),
    ]


def detail_stats(rolled: DataFrame) -> DataFrame:
    """One row of totals over per-track rows, also when there are none."""
    stats = rolled.agg(
        *totals(),
        track_count().alias("unique_tracks"),
        F.min("first_listen").alias("first"),
    )
    return stats.select(
        F.col("play_count").alias("total_plays"),
        "total_ms",
        listening_time(F.col("total_ms")).alias("listening_time"),
        "unique_tracks",
        F.coalesce(F.col("first").cast("string"), F.lit("N/A")).alias("first_listen"),
    )
