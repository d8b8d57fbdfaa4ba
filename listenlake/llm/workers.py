"""Sends this package to the Python workers, so that they can import what tasks name."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch at most: whole texts are long, and executors and workers hold a batch at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20

#: Parquet's reads of many ranges at once keep direct buffers beside the heap, one per reading thread; a session may set it to "true".
RANGES_AT_ONCE = "parquet.hadoop.vectored.io.enabled"

_sent: weakref.WeakSet = weakref.WeakSet()


def send_package(spark: SparkSession) -> None:
    """Once per Spark application, by Spark's own file server; batches for workers and buffers for reads are kept small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(spark.conf.get(size)).lower().rstrip("b")
    if not (given.isdigit() and 0 < int(given) <= BATCH_BYTES):
        spark.conf.set(size, str(BATCH_BYTES))
    if spark.conf.get(RANGES_AT_ONCE, None) is None:
        spark.conf.set(RANGES_AT_ONCE, "false")
    context = spark.sparkContext
    if context in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.join(root, __name__.split(".")[0])
    path = os.path.join(tempfile.mkdtemp(), "package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    archive.write(whole, os.path.relpath(whole, root))
    context.addPyFile(path)
    _sent.add(context)
