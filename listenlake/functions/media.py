"""Expressions over track metadata and raw plays."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from listenlake.schemas import RELEASE_SCORES


def release_score(album_type: Column) -> Column:
    """Rank of a release type; unknown and missing types score 0."""
    scores = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RELEASE_SCORES.items()))
    return F.coalesce(F.try_element_at(scores, album_type), F.lit(0))


def seconds_to_ms(seconds: Column) -> Column:
    """Rounded to whole ms, so that 1.001 s is 1001 ms."""
    return F.round(seconds * 1000).cast("long")


def main_artist(artists: Column) -> Column:
    """The first credit, or null when the list is empty."""
    return F.get(artists, F.lit(0))


def featured_artists(artists: Column) -> Column:
    """All credits but the first."""
    return F.when(F.size(artists) > 1, F.slice(artists, F.lit(2), F.size(artists) - 1)).otherwise(
        F.slice(artists, 1, 0)
    )
