"""A manifest of the live play files, their compaction and the expiry of files no manifest lists.

    <base>/manifest/<seq>-<id>     one table per commit: a row per live data file
    <base>/claims/m<seq>           made once, so that two commits cannot both be number seq

A row names a file and what a reader prunes by: year, library bucket, the tries (attempts)
whose plays it holds, rows, bytes and the least and greatest library.  Readers take the
newest manifest that `versions` lists and open those files alone; folders are not listed.
A commit writes a whole new manifest beside the old ones and then claims its number; the
one that loses the claim starts again from the winner's manifest.  So a reader sees the
state before or after a commit, never a mix, and compaction never hides plays: the files it
replaces stay until `expire_files` removes what no recent manifest lists.

Files of an import hold one try, named by their folder (`batch=<try>`); compacted files hold
plays of many tries and name each row's try in the column `attempt`.  When a batch is
imported again, files of its older tries leave the manifest, and compacted files that also
hold other tries are rewritten without those rows.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("library_bucket", T.IntegerType()),
    T.StructField("attempts", T.ArrayType(T.StringType())),
    T.StructField("rows", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("min_library", T.StringType()),
    T.StructField("max_library", T.StringType()),
])
#: Files below half of this are packed together by compaction, into files of about this size.
TARGET_BYTES = 128 << 20
#: Commits that lose their number to another try again so often.
RETRIES = 20
#: A file that no manifest lists is left so long, as an import may still be writing it.
GRACE_SECONDS = 3600
#: A manifest number claimed so long ago and not listed is taken for the claim of a commit that died.
CLAIM_SECONDS = 600


def files(spark: SparkSession):
    """The Hadoop file system calls of the session."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def fs(path: str):
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(conf)

    return fs


def claim(spark: SparkSession, path: str) -> bool:
    """Create `path` unless it exists: True for the one caller that made it."""
    hadoop, fs = files(spark)(path)
    try:
        fs.create(hadoop, False).close()
        return True
    except Py4JJavaError:
        return False


def stats(rows: DataFrame, attempt: str | None = None) -> DataFrame:
    """Manifest rows of the files `rows` was read from; `attempt` names the try of files that do not say it."""
    tried = F.coalesce(F.col("attempt"), F.lit(attempt)) if "attempt" in rows.columns else F.lit(attempt)
    named = "path" in rows.columns
    return rows.select(
        F.col("path" if named else "_metadata.file_path").alias("path"), F.col("bytes" if named else "_metadata.file_size").alias("bytes"),
        "year", "library_bucket",
        tried.alias("_try"), "library",
    ).groupBy("path", "bytes", "year", "library_bucket").agg(
        F.array_sort(F.collect_set("_try")).alias("attempts"), F.count(F.lit(1)).alias("rows"),
        F.min("library").alias("min_library"), F.max("library").alias("max_library"),
    ).select(*MANIFEST.fieldNames())


class Manifest:
    """Commits of the live file list of one lake; `store` lists them in its versions."""

    def __init__(self, store):
        self.store, self.spark, self.base = store, store.spark, store.base

    @property
    def plays_dir(self) -> str:
        return f"{self.base}/plays"

    def newest(self) -> tuple[int, str] | None:
        """(seq, folder) of the newest listed manifest."""
        versions = self.store.versions()
        if versions is None:
            return None
        row = versions.filter("manifest is not null").agg(F.max(F.struct("seq", "manifest")).alias("m")).first()["m"]
        return None if row is None else (row["seq"], row["manifest"])

    def table(self, newest: tuple[int, str] | None = None) -> DataFrame:
        newest = newest or self.newest()
        if newest is None:
            return self.store._bootstrap()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/{newest[1]}")

    def read_files(self, paths: list[str], schema: T.StructType) -> DataFrame:
        """Rows of the listed files, partition columns from their folders and a null `attempt` where files have none."""
        wide = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], wide)
        return self.spark.read.option("basePath", self.plays_dir).schema(wide).parquet(*paths)

    def attempt_files(self, attempt: str, schema: T.StructType) -> DataFrame:
        """Manifest rows of the files one import try wrote (none if it wrote no rows)."""
        wide = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
        try:
            rows = self.spark.read.option("basePath", self.plays_dir).schema(wide).parquet(
                f"{self.plays_dir}/year=*/library_bucket=*/batch={attempt}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], MANIFEST)
            raise
        return stats(rows.drop("attempt"), attempt)

    def commit(self, change, batch: str, folder: str | None = None, version: int | None = None, attempt: str | None = None) -> int:
        """Write `change(old manifest)` as the next manifest and list it; returns its number.

        `change` may be called again, on a newer manifest, when another commit took the number first.
        """
        for tried in range(RETRIES):
            newest = self.newest()
            seq = 0 if newest is None else newest[0] + 1
            # A number claimed long ago and never listed belongs to a commit that died: it is passed over.
            while self._abandoned(seq):
                seq += 1
            name = f"{seq}-{uuid.uuid4().hex}"
            change(self.table(newest)).select(*MANIFEST.fieldNames()).write.parquet(f"{self.base}/manifest/{name}")
            if claim(self.spark, f"{self.base}/claims/m{seq}"):
                self.store._list(version, batch, folder, attempt, manifest=name, seq=seq)
                return seq
            time.sleep(min(2 ** tried, 30) * 0.1)
        raise RuntimeError(f"no manifest number of {self.base} was free in {RETRIES} tries")

    def _abandoned(self, seq: int) -> bool:
        """Whether number `seq` was claimed over CLAIM_SECONDS ago (and, being above the newest, never listed)."""
        path, fs = files(self.spark)(f"{self.base}/claims/m{seq}")
        return bool(fs.exists(path)) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > CLAIM_SECONDS

    def replace_tries(self, old: DataFrame, gone: list[str], schema: T.StructType) -> DataFrame:
        """`old` without the plays of the tries `gone`: files of those alone leave, mixed files are rewritten."""
        if not gone:
            return old
        hit = F.arrays_overlap("attempts", F.array(*[F.lit(a) for a in gone]))
        mixed = old.filter(hit & (F.size(F.array_except("attempts", F.array(*[F.lit(a) for a in gone]))) > 0))
        paths = [r["path"] for r in mixed.select("path").collect()]
        kept = old.filter(~hit)
        if not paths:
            return kept
        rows = self.read_files(paths, schema)
        rows = rows.withColumn("attempt", F.coalesce("attempt", "batch")).filter(~F.col("attempt").isin(gone))
        return kept.unionByName(self._write_packed(rows.withColumn("_bin", F.lit(0)), schema))

    def _write_packed(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        """Write rows (with `attempt` and `_bin`) as compacted files, one a (year, bucket, bin); their manifest rows."""
        name = f"compact-{uuid.uuid4().hex}"
        (
            rows.withColumn("batch", F.lit(name))
            .repartition("year", "library_bucket", "_bin")
            .sortWithinPartitions("year", "library_bucket", "library", "played_at_date")
            .select(*schema.fieldNames(), "attempt")
            .write.partitionBy("year", "library_bucket", "batch").parquet(f"{self.plays_dir}", mode="append")
        )
        try:
            written = self.spark.read.option("basePath", self.plays_dir).schema(
                T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
            ).parquet(f"{self.plays_dir}/year=*/library_bucket=*/batch={name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], MANIFEST)
            raise
        return stats(written)

    def compact(self, schema: T.StructType, target_bytes: int = TARGET_BYTES) -> int | None:
        """Pack small files of each (year, bucket) into files of about `target_bytes`; the new manifest's number, None if nothing to pack."""
        newest = self.newest()
        old = self.table(newest)
        small = old.filter(F.col("bytes") < target_bytes // 2)
        place = Window.partitionBy("year", "library_bucket").orderBy("path")
        binned = small.withColumn("_bin", F.floor((F.sum("bytes").over(place) - F.col("bytes")) / target_bytes))
        binned = binned.withColumn("_files", F.count(F.lit(1)).over(Window.partitionBy("year", "library_bucket", "_bin")))
        chosen = [(r["path"], r["_bin"]) for r in binned.filter("_files > 1").select("path", "_bin").collect()]
        if not chosen:
            return None
        bins = self.spark.createDataFrame(chosen, "path string, _bin long")
        rows = self.read_files([p for p, _ in chosen], schema).withColumn("attempt", F.coalesce("attempt", "batch"))
        rows = rows.withColumn("path", F.col("_metadata.file_path")).join(F.broadcast(bins), "path").drop("path")
        # The new files' rows: one per file, a few hundred at most per compaction of a (year, bucket).
        added_rows = self._write_packed(rows, schema).collect()
        gone = {p for p, _ in chosen}

        def change(current: DataFrame) -> DataFrame:
            # Files another commit removed meanwhile are not brought back; their rows are then in both.
            return current.filter(~F.col("path").isin(list(gone))).unionByName(self.spark.createDataFrame(added_rows, MANIFEST))

        return self.commit(change, "compact")

    def expire(self, keep: int = 2, grace_seconds: int = GRACE_SECONDS) -> int:
        """Delete data files that none of the newest `keep` manifests lists, and older manifests; the number of files deleted.

        A file no manifest ever listed may be of an import still running: it goes only when older than `grace_seconds`.
        """
        versions = self.store.versions()
        if versions is None:
            return 0
        listed = [r["manifest"] for r in versions.filter("manifest is not null").orderBy(F.col("seq").desc()).select("manifest").collect()]
        if not listed:
            return 0
        live, replaced = set(), set()
        for i, name in enumerate(listed):
            paths = {_key(r["path"]) for r in self.table((0, name)).select("path").collect()}
            (live if i < keep else replaced).update(paths)
        fs = files(self.spark)
        _, system = fs(self.plays_dir)
        deleted, now = 0, time.time() * 1000
        for status in system.globStatus(fs(f"{self.plays_dir}/year=*/library_bucket=*/batch=*/*.parquet")[0]) or []:
            key = _key(status.getPath().toString())
            if key in live:
                continue
            if key in replaced or now - status.getModificationTime() > grace_seconds * 1000:
                system.delete(status.getPath(), False)
                deleted += 1
        for status in system.globStatus(fs(f"{self.plays_dir}/year=*/library_bucket=*/batch=*")[0]) or []:
            if not [s for s in system.listStatus(status.getPath()) if s.getPath().getName().endswith(".parquet")]:
                if now - status.getModificationTime() > grace_seconds * 1000 or all(not k.startswith(_key(status.getPath().toString())) for k in live):
                    system.delete(status.getPath(), True)
        for name in listed[keep:]:
            path, system = fs(f"{self.base}/manifest/{name}")
            system.delete(path, True)
        return deleted


def _key(path: str) -> str:
    """A file's path without the ways of writing its scheme: `file:/x` and `file:///x` are one file."""
    parts = urlparse(path)
    return f"{parts.netloc}{unquote(parts.path)}"
