"""A time hierarchy of partial sums: per (library, recording) totals by day, by month and by year.

A date range is cut into at most two edges of days, at most two edges of months and a run of whole
years; each part reads its own level, so a report over whole years reads one row per (library,
recording, year) and no play.  Sums are additive: `add` appends the sums of new plays as more rows,
and readers sum again, so an import writes only its own rows.  The tables are partitioned by year,
so a range reads the folders of its years alone.

The result has the columns of `rollup`: (library, if per library) track_isrc, total_ms, play_count,
first_listen; plays without a code count under the same key, their time counts and their plays do
not.  Plays without a date are in the whole-time sums only, as a range leaves them out.  Sums do not
follow a batch that is imported again (replaced): rebuild them with `build` then.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from listenlake.lake import Lake
from listenlake.operators.filters import _as_date
from listenlake.operators.rollup import per_track
from listenlake.session import scratch_path

LEVELS = ("day", "month", "year")
_SUMMED = ["total_ms", "play_count", "first_listen"]


def pieces(start: dt.date | None, end: dt.date | None) -> list[tuple[str, object, object]]:
    """(level, low, high) parts that cover [start, end] exactly: edge days, edge months, whole years between."""
    if start is None and end is None:
        return [("all", None, None)]
    s, e = start or dt.date(1, 1, 1), end or dt.date(9999, 12, 31)
    if s > e:
        return []
    one = dt.timedelta(days=1)
    out, tail = [], []

    def month_end(d: dt.date) -> dt.date:
        return (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - one

    if s.day != 1:
        stop = min(e, month_end(s))
        out.append(("day", s, stop))
        s = stop + one
    if s <= e and e != month_end(e):
        first = max(s, e.replace(day=1))
        tail.append(("day", first, e))
        e = first - one
    if s <= e and s.month != 1:
        stop = min(e, dt.date(s.year, 12, 31))
        out.append(("month", s, stop))
        s = stop + one
    if s <= e and e.month != 12:
        first = max(s, dt.date(e.year, 1, 1))
        tail.insert(0, ("month", first, e))
        e = first - one
    if s <= e:
        out.append(("year", s.year, e.year))
    return out + tail


@dataclass(frozen=True)
class Sums:
    """Stored day, month and year sums of one lake's plays."""

    spark: SparkSession
    path: str

    def level(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, lake: Lake, path: str | None = None) -> "Sums":
        sums = cls(lake.plays.sparkSession, path or scratch_path(lake.plays.sparkSession, "sums"))
        sums.add(lake.plays)
        return sums

    def add(self, plays: DataFrame) -> None:
        """Append the sums of `plays`: days first, the coarser levels from the stored days of this batch."""
        day = per_track(plays, ["library", "played_at_date"]).withColumnRenamed("played_at_date", "at")
        stage = scratch_path(self.spark, "sums-batch")
        day.withColumn("year", F.year("at")).write.parquet(stage)
        day = self.spark.read.parquet(stage)
        month = day.groupBy("library", "track_isrc", F.trunc("at", "month").alias("at"), "year").agg(*_again())
        year = day.groupBy("library", "track_isrc", "year").agg(*_again())
        for name, table in (("day", day), ("month", month), ("year", year)):
            table.write.mode("append").partitionBy("year").parquet(f"{self.path}/{name}")

    def rollup(self, start=None, end=None, library: str | None = None, per_library: bool = False) -> DataFrame:
        """Per-track totals of [start, end] from the sums, as `operators.rollup.rollup` gives them from plays."""
        parts = []
        for level, low, high in pieces(_as_date(start), _as_date(end)):
            if level == "all":
                table = self.level("year")
            elif level == "year":
                table = self.level("year").filter(F.col("year").between(low, high))
            else:
                table = self.level(level).filter(F.col("year").between(low.year, high.year) & F.col("at").between(F.lit(low), F.lit(high)))
            if library is not None:
                table = table.filter(F.col("library") == library)
            parts.append(table.select("library", "track_isrc", *_SUMMED))
        lead = ["library"] if per_library else []
        if not parts:
            return self.level("year").limit(0).select(*lead, "track_isrc", *_SUMMED)
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union.groupBy(*lead, "track_isrc").agg(*_again())


def _again():
    return [F.sum("total_ms").alias("total_ms"), F.sum("play_count").alias("play_count"), F.min("first_listen").alias("first_listen")]
