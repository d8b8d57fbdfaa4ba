"""The five tables every report reads, as one value."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Lake:
    """Lazy handles on the catalog and the plays.

    One catalog serves all libraries; `plays.library` says whose play it is.
    `buckets` is the number of library folders per year of a stored lake.
    """

    artists: DataFrame
    albums: DataFrame
    tracks: DataFrame
    track_features: DataFrame
    plays: DataFrame
    track_aliases: DataFrame | None = None
    buckets: int | None = None

    def with_tables(self, **tables: DataFrame) -> "Lake":
        return replace(self, **tables)
