"""Ordering, limits and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from listenlake.session import cut_lineage


def metric(param: int) -> str:
    """1 orders by plays, anything else by time."""
    return "play_count" if param == 1 else "total_ms"


def top_k(df: DataFrame, by: str, keys: Sequence[str], limit: int) -> DataFrame:
    """The `limit` largest rows by `by`, ties by `keys`; a negative limit keeps all.

    Sort plus limit is one bounded heap per task, with no full sort.
    """
    ordered = df.orderBy(F.desc(by), *keys)
    return ordered if limit < 0 else ordered.limit(limit)


def top_k_per_group(df: DataFrame, group: str, by: str, keys: Sequence[str], limit: int) -> DataFrame:
    """`top_k` within each `group`.

    Spark cuts each map task to `limit` rows per group before the shuffle, so
    a large group sends only its candidates.
    """
    if limit < 0:
        return df
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), *keys))
    return df.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def top(df: DataFrame, by: str, keys: Sequence[str], limit: int, per_library: bool = False) -> DataFrame:
    if per_library:
        return top_k_per_group(df, "library", by, keys, limit)
    return top_k(df, by, keys, limit)


#: Lists of up to so many rows are numbered in one task.
SHORT_LIST = 10_000


def with_rank(df: DataFrame, by: str, keys: Sequence[str], limit: int, group: str | None = None) -> DataFrame:
    """Number the rows of a list cut to `limit` (negative: all), per `group` if one is given.

    Only a list known to be short is numbered in one task; any other by `number_rows`.
    """
    order = [F.desc(by), *keys]
    if group:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if 0 <= limit <= SHORT_LIST:
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return number_rows(df, order).withColumn("rank", F.col("rank").cast("int"))


def number_rows(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Add `rank`, the place of each row in `order`, from 1.

    The sorted parts are stored; a row's place is its place in its part plus the rows of the
    parts before.  One row per part is all that meets in a task.
    """
    # A stored row number holds the part in its upper bits and the place in its lower 33.
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    stored = cut_lineage(df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.shiftleft("_part", 33)
    return stored.withColumn("_part", part).join(offsets, "_part").withColumn(
        "rank", place + F.col("_before") + 1).drop("_at", "_part", "_before")


def medal(rank: Column) -> Column:
    """`top-1` to `top-3`, empty below."""
    return F.when(rank <= 3, F.concat(F.lit("top-"), rank.cast("string"))).otherwise(F.lit(""))
