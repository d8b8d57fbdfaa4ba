"""listenlake: listening-history analytics as Spark DataFrame jobs."""

from listenlake.lake import Lake

__all__ = ["Lake"]
