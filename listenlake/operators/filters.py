"""Row filters over raw histories and stored plays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.schemas import MIN_LISTEN_MS


def library_bucket(library: Column, buckets: int) -> Column:
    """Folder number of a library in a stored lake."""
    return F.pmod(F.xxhash64(library), F.lit(buckets)).cast("int")


def _as_date(value: str | dt.date | None) -> dt.date | None:
    if value is None or value == "":
        return None
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def in_range(plays: DataFrame, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """Plays from `start` to `end`, both included; an empty bound is no bound.

    Spark cannot derive the partition column from the date, so the same bound
    is put on `year` too where the table has it.
    """
    start, end = _as_date(start), _as_date(end)
    by_year = "year" in plays.columns
    if start is not None:
        plays = plays.filter(F.col("played_at_date") >= F.lit(start))
        if by_year:
            plays = plays.filter(F.col("year") >= start.year)
    if end is not None:
        plays = plays.filter(F.col("played_at_date") <= F.lit(end))
        if by_year:
            plays = plays.filter(F.col("year") <= end.year)
    return plays


def preset_range(preset: str, today: dt.date | None = None) -> tuple[dt.date | None, dt.date | None]:
    """Bounds of `all`, `this_year` or `last_year`."""
    year = (today or dt.date.today()).year
    if preset == "all":
        return None, None
    if preset == "this_year":
        return dt.date(year, 1, 1), dt.date(year, 12, 31)
    if preset == "last_year":
        return dt.date(year - 1, 1, 1), dt.date(year - 1, 12, 31)
    raise ValueError(f"unknown preset {preset!r}")


def of_library(plays: DataFrame, library: str | None, buckets: int | None = None) -> DataFrame:
    """Plays of one library, pruned to its folders in a stored lake; None keeps all."""
    if library is None:
        return plays
    plays = plays.filter(F.col("library") == library)
    if buckets is not None:
        plays = plays.filter(F.col("library_bucket") == library_bucket(F.lit(library), buckets))
    return plays


def long_enough(history: DataFrame, strict: bool, listened: Column | None = None) -> DataFrame:
    """Drop short listens: platform A keeps exactly 30 s, platform B (strict) does not.

    `listened` is the time in ms, `ms_played` by default.
    """
    listened = F.col("ms_played") if listened is None else listened
    return history.filter(listened > MIN_LISTEN_MS if strict else listened >= MIN_LISTEN_MS)


def without_episodes(history: DataFrame) -> DataFrame:
    return history.filter(F.col("episode_name").isNull())


def drop_unkeyed(df: DataFrame, key: str) -> DataFrame:
    return df.dropna(subset=[key])
