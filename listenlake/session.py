"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Lists per group of up to so many rows are cut in each map task before the shuffle (Spark's default: 1,000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the jobs are designed for.

    On a cluster leave `master` and the partition count to spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def send_by_value(module: str) -> None:
    """Send a module's functions to Python workers as they are, so that workers need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Plans run inside send Python workers batches of 10,000 rows at most, whatever their bytes.

    Spark measures a batch again at each row to hold a limit of bytes, which costs more than writing a short row.
    Only for rows of bounded size.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}
    old = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


#: Rows a task is given where their number is known and sums of them are held in memory.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for `rows` rows: they grow with the rows, and are no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="listenlake-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back.

    Losing executors then loses no work, later plans start small, and unlike a
    checkpoint the table has columns to prune and a size to plan joins by.
    """
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """`cut_lineage` and the table's path, for who removes it when all that reads it is stored itself."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared scratch."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
