"""Continued lists: a ranked list is stored once, and each further page reads the one or two parts its ranks lie in.

A ranking is numbered by `number_rows` (range partitions, no single task) and written in
folders of `BLOCK` ranks each, sorted by rank.  A page after a cursor filters by the folder
(partition pruning) and the rank range (pushed down), so "25 more" reads a part, not the list,
and ranks never change between pages of one stored ranking.  A cursor is (rank, metric, key)
of the last row shown; if a cursor comes from another ranking, its metric and key still
place it: the next page then starts behind that row in (metric desc, key) order.  Ties on a
page border are broken by the key, as in the full list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from listenlake.operators.topk import number_rows
from listenlake.session import scratch_path

#: Ranks a stored folder holds.
BLOCK = 1_000


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: its last rank, and the metric and key of that row."""

    rank: int
    metric: object = None
    key: object = None


class StoredRanking:
    """A ranked list by `by` (descending), ties by `key` (ascending), stored at `path`."""

    def __init__(self, spark, path: str, by: str, key: str, schema=None):
        self.spark, self.path, self.by, self.key, self.schema = spark, path, by, key, schema

    @classmethod
    def store(cls, rows: DataFrame, by: str, key: str, path: str | None = None) -> "StoredRanking":
        path = path or scratch_path(rows.sparkSession, "ranking")
        numbered = number_rows(rows, [F.desc(by), F.col(key)]).withColumn("_block", F.floor((F.col("rank") - 1) / BLOCK))
        numbered.repartition("_block").sortWithinPartitions("rank").write.partitionBy("_block").parquet(path)
        return cls(rows.sparkSession, path, by, key, numbered.schema)

    def table(self) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(self.schema) if self.schema is not None else reader).parquet(self.path)

    def page(self, after: Cursor | None = None, size: int = 25) -> DataFrame:
        """The `size` rows behind `after` (from the top without one), in rank order."""
        first = 0 if after is None else after.rank
        rows = self.table()
        if after is not None and after.metric is not None:
            # The row the cursor names must stand at its rank here, else the page starts behind it by metric and key.
            at = rows.filter((F.col("_block") == (first - 1) // BLOCK) & (F.col("rank") == first)).select(self.by, self.key).first() if first > 0 else None
            if at is None or at[0] != after.metric or at[1] != after.key:
                behind = (F.col(self.by) < after.metric) | ((F.col(self.by) == after.metric) & (F.col(self.key) > after.key))
                return rows.filter(behind).orderBy("rank").limit(size).drop("_block")
        blocks = list(range(first // BLOCK, (first + size - 1) // BLOCK + 1)) if size > 0 else []
        return rows.filter(F.col("_block").isin(blocks) & (F.col("rank") > first) & (F.col("rank") <= first + size)).orderBy("rank").drop("_block")

    def cursor(self, page: DataFrame) -> Cursor | None:
        """The cursor behind the last row of `page`; None for an empty page."""
        last = page.orderBy(F.desc("rank")).select("rank", self.by, self.key).first()
        return None if last is None else Cursor(int(last["rank"]), last[self.by], last[self.key])

    def cursors(self, size: int) -> DataFrame:
        """(page, rank, metric, key): the cursor in front of every page of `size` rows; the first page's is rank 0."""
        ends = self.table().filter(F.col("rank") % size == 0).select(
            (F.col("rank") / size).cast("int").alias("page"), F.col("rank").cast("long").alias("rank"),
            F.col(self.by).alias("metric"), F.col(self.key).alias("key"))
        first = self.spark.range(1).select(F.lit(0).alias("page"), F.lit(0).cast("long").alias("rank"))
        return ends.unionByName(first, allowMissingColumns=True)


def pages(ranking: StoredRanking, size: int, columns: Sequence[str]) -> DataFrame:
    """Every page of a stored ranking, one after another by cursors, with its number: what a reader paging to the end sees.

    The cursors of all pages are read from the ranking in one go, and each page is the `size` rows behind its own: one
    plan of fixed size however many pages there are.
    """
    if size < 1:
        raise ValueError("a page holds at least one row")
    cursors = ranking.cursors(size).select("page", F.col("rank").alias("_after"))
    paged = ranking.table().withColumn("page", F.floor((F.col("rank") - 1) / size).cast("int"))
    read = paged.join(cursors, "page").filter((F.col("rank") > F.col("_after")) & (F.col("rank") <= F.col("_after") + size))
    return read.select(*columns, "rank", "page")
