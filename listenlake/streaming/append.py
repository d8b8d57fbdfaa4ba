"""Incremental append: new files become plays once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from listenlake.plans.imports import import_library, known_aliases, resolve_plays
from listenlake.schemas import HISTORY_FILE_GLOB
from listenlake.sources.history import history_files, normalize_a, parse_history
from listenlake.sources.store import LakeStore


def stream_history(spark: SparkSession, path: str, name_glob: str = HISTORY_FILE_GLOB) -> DataFrame:
    """Platform A rows of the files in a folder, as they arrive."""
    return parse_history(history_files(
        spark.readStream.text(path, wholetext=True, pathGlobFilter=name_glob)
    ))


def batch_name(batch: DataFrame, name: str, number: int) -> str:
    """Name of a stream's batch: the stream's own id, kept in its checkpoint, tells streams of one name apart."""
    return f"{name}-{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"


def append_stream(rows: DataFrame, store: LakeStore, checkpoint: str, name: str,
                  to_plays: Callable[[DataFrame], DataFrame] | None = None,
                  write_batch: Callable[[DataFrame, str], object] | None = None) -> None:
    """Add what has arrived since the last run, then stop.

    The checkpoint lets each file in once.  A batch that is tried again
    replaces its own plays, so nothing is counted twice.  `write_batch` takes
    the batch and its name; by default the plays `to_plays` makes are added.
    """
    store.create()

    def write(batch: DataFrame, number: int) -> None:
        key = batch_name(batch, name, number)
        if write_batch:
            write_batch(batch, key)
        else:
            store.append_plays(to_plays(batch), key)

    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_history(store: LakeStore, path: str, checkpoint: str, name: str,
                   library: Column | str = "", name_glob: str = HISTORY_FILE_GLOB,
                   metadata: DataFrame | None = None) -> None:
    """Add new platform A files of a folder.

    With `metadata` every batch is an import: songs the catalog does not know are looked up and join it.
    Without, plays are resolved against the stored catalog and unknown ones keep a null code.
    """
    rows = stream_history(store.spark, path, name_glob)
    if metadata is None:
        append_stream(rows, store, checkpoint, name, lambda batch: resolve_plays(
            normalize_a(batch, library), known_aliases(store.read())))
    else:
        append_stream(rows, store, checkpoint, name, write_batch=lambda batch, key: import_library(
            store, key, normalize_a(batch.persist(), library), None, metadata))
