"""Track metadata, supplied as a table of nested track objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listenlake.operators.releases import flatten_metadata
from listenlake.schemas import TRACK_METADATA


def read_track_metadata(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(TRACK_METADATA).format(format).load(path)


def candidates_by_id(wanted: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of (spotify_id, seq) rows; ids without metadata drop.

    `spotify_id` becomes the id of the page, which may differ from the one asked for.
    """
    asked = wanted.select(F.col("spotify_id").alias("requested_id"), "seq")
    return asked.join(flatten_metadata(metadata), "requested_id")


def candidates_by_isrc(wanted: DataFrame, metadata: DataFrame) -> DataFrame:
    """All search results of (isrc, seq) rows; `search_rank` and `spotify_id` give their order."""
    return flatten_metadata(metadata).join(wanted.select("isrc", "seq"), "isrc")
