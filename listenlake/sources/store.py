"""The stored lake: versioned catalog tables and an append-only play table.

    <base>/catalog/<folder>/<table>      one full catalog per import
    <base>/plays/year=/library_bucket=/batch=
    <base>/versions                      one row per finished import: catalog folder, bucket count, plays' attempt
    <base>/claims/<n>                    made once for each version, so that two imports cannot both take it
    <base>/manifest/<seq>-<id>           the live play files with their bounds (see `manifest`)

A reader takes the newest version that `versions` lists, and the play files the newest
manifest lists, pruned by library bucket and library bounds: neither half-written catalogs
nor plays of broken-off or replaced imports are seen, and no folder is listed.  A lake
written before manifests existed is read by its listed attempts until its first commit.  Plays are spread by year and a hash of the library, not
by library: millions of listeners would be millions of folders.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from listenlake.lake import Lake
from listenlake.operators.filters import library_bucket, of_library
from listenlake.schemas import CATALOG_TABLES, PLAYS
from listenlake.sources.manifest import MANIFEST, Manifest, stats

VERSIONS = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("batch", T.StringType()),
    T.StructField("buckets", T.IntegerType()),
    T.StructField("folder", T.StringType()),
    T.StructField("attempt", T.StringType()),
    T.StructField("at", T.LongType()),
    T.StructField("manifest", T.StringType()),
    T.StructField("seq", T.LongType()),
])
#: A claim that no listed version follows within so many seconds is left over from a lost import.
CLAIM_SECONDS = 600


class VersionTaken(RuntimeError):
    """Another import has finished on the catalog this one started from."""


STORED_PLAYS = T.StructType([
    *PLAYS.fields,
    T.StructField("year", T.IntegerType()),
    T.StructField("library_bucket", T.IntegerType()),
    T.StructField("batch", T.StringType()),
])


class LakeStore:
    """One lake below `base`.

    `buckets` counts the library folders of a year in a new lake; one that
    exists keeps its own count.  Choose it so that a folder of one year holds
    some hundred files.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark = spark
        self.base = base.rstrip("/")
        self.manifest = Manifest(self)
        newest = self._newest()
        self.buckets = buckets if newest is None else newest["buckets"]

    def empty(self) -> Lake:
        """The five tables and the aliases without rows."""
        tables = {name: self.spark.createDataFrame([], schema) for name, schema in CATALOG_TABLES.items()}
        return Lake(plays=self.spark.createDataFrame([], PLAYS), **tables)

    def create(self) -> "LakeStore":
        """Write empty tables unless the lake exists already."""
        if self.version() is None:
            lake = self.empty()
            attempt = self.append_plays(lake.plays, "create", commit=False)
            try:
                self.write_catalog(lake, "create", attempt, None)
            except VersionTaken:
                pass  # someone else has just made it
        return self

    def versions(self) -> DataFrame | None:
        """The listed commits; None for no lake."""
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.base}/versions")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _newest(self) -> Row | None:
        versions = self.versions()
        if versions is None:
            return None
        listed = versions.filter("folder is not null")
        return listed.agg(F.max(F.struct("version", "buckets", "folder")).alias("newest")).first()["newest"]

    def version(self) -> int | None:
        """The newest finished version, None for no lake."""
        newest = self._newest()
        return None if newest is None else newest["version"]

    def finished(self, batch: str) -> bool:
        """Whether an import with this name has been completed."""
        versions = self.spark.read.schema(VERSIONS).parquet(f"{self.base}/versions")
        return not versions.filter((F.col("batch") == batch) & F.col("folder").isNotNull()).isEmpty()

    def read(self, library: str | None = None) -> Lake:
        """Handles on the newest tables; `library` prunes plays to one listener."""
        catalog = f"{self.base}/catalog/{self._newest()['folder']}"
        tables = {
            name: self.spark.read.schema(schema).parquet(f"{catalog}/{name}")
            for name, schema in CATALOG_TABLES.items()
        }
        return Lake(plays=self.read_plays(library), buckets=self.buckets, **tables)

    def read_plays(self, library: str | None = None) -> DataFrame:
        """Plays of the files the newest manifest lists; `library` keeps the files of its bucket and bounds."""
        newest = self.manifest.newest()
        if newest is None:
            return of_library(self._legacy_plays(), library, self.buckets)
        listed = self.manifest.table(newest)
        if library is not None:
            bucket = self.spark.range(1).select(library_bucket(F.lit(library), self.buckets)).first()[0]
            listed = listed.filter((F.col("library_bucket") == bucket) & (F.col("min_library") <= library) & (F.col("max_library") >= library))
        # The driver lists files to plan a scan in any case; here it reads them from the manifest instead of folders.
        paths = [r["path"] for r in listed.select("path").collect()]
        plays = self.manifest.read_files(paths, STORED_PLAYS).withColumn("batch", F.coalesce("attempt", "batch")).select(*STORED_PLAYS.fieldNames())
        return of_library(plays, library, self.buckets)

    def _legacy_plays(self, files: bool = False) -> DataFrame:
        """Plays of a lake without a manifest: folders listed, the newest attempt of each batch; `files` adds file path and size."""
        try:
            plays = self.spark.read.schema(STORED_PLAYS).parquet(f"{self.base}/plays")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                plays = self.spark.createDataFrame([], STORED_PLAYS)
                return plays.selectExpr("*", "'' as path", "0L as bytes").limit(0) if files else plays
            raise
        if files:
            plays = plays.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return plays.join(self._attempts(), "batch", "left_semi")

    def _files_of_batch(self, old: DataFrame, batch: str, attempt: str) -> DataFrame:
        """The manifest `old` with `batch`'s earlier tries replaced by the files of `attempt`."""
        versions = self.versions()
        gone = [] if versions is None else [r["attempt"] for r in versions.filter(
            (F.col("batch") == batch) & F.col("attempt").isNotNull() & (F.col("attempt") != attempt)).select("attempt").distinct().collect()]
        return self.manifest.replace_tries(old, gone, STORED_PLAYS).unionByName(self.manifest.attempt_files(attempt, STORED_PLAYS))

    def _bootstrap(self) -> DataFrame:
        """Manifest rows of a lake written before manifests: the files of its listed attempts."""
        if self.versions() is None:
            return self.spark.createDataFrame([], MANIFEST)
        return stats(self._legacy_plays(files=True).withColumn("attempt", F.col("batch")))

    def compact_plays(self, target_bytes: int | None = None) -> int | None:
        """Pack small play files; the new manifest's number, or None when nothing was small enough to pack."""
        return self.manifest.compact(STORED_PLAYS, *([target_bytes] if target_bytes else []))

    def expire_files(self, keep: int = 2, grace_seconds: int | None = None) -> int:
        """Delete play files that the newest `keep` manifests do not list; see `Manifest.expire`."""
        return self.manifest.expire(keep, *([grace_seconds] if grace_seconds is not None else []))

    def _commit(self, batch: str, attempt: str, folder: str | None, version: int | None) -> None:
        """List `attempt`'s plays (and the catalog `folder`) in a new manifest."""
        self.manifest.commit(lambda old: self._files_of_batch(old, batch, attempt), batch, folder, version, attempt)

    def _attempts(self) -> DataFrame:
        """(batch): the folder name of the plays that count for each batch."""
        versions = self.spark.read.schema(VERSIONS).parquet(f"{self.base}/versions").filter("attempt is not null")
        return versions.groupBy("batch").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt")).select(
            F.col("attempt").alias("batch"))

    def _list(self, version: int, batch: str, folder: str | None, attempt: str | None, manifest: str | None = None, seq: int | None = None) -> None:
        row = (version, batch, self.buckets, folder, attempt, time.time_ns() // 1000, manifest, seq)
        self.spark.createDataFrame([row], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.base}/versions")

    def _claim(self, version: int) -> None:
        """Make the version's claim, which only one import can."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/claims/{version}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path) and time.time() - files.getFileStatus(path).getModificationTime() / 1000 > CLAIM_SECONDS:
            files.delete(path, False)
        try:
            files.create(path, False).close()
        except Py4JJavaError as error:
            raise VersionTaken(f"version {version} of {self.base} is taken") from error

    def write_catalog(self, lake: Lake, batch: str, attempt: str | None = None, based_on: int | None = -1) -> int:
        """Write all catalog tables beside the old ones, then list the new version.

        `based_on` is the version `lake` was made from (by default the newest): if another import has
        finished since, or is about to, this raises VersionTaken and lists nothing.  `attempt` lists the
        plays written with `append_plays(…, commit=False)` at the same moment.
        """
        based_on = self.version() if based_on == -1 else based_on
        version = 0 if based_on is None else based_on + 1
        folder = f"version={version}-{uuid.uuid4().hex}"
        for name, schema in CATALOG_TABLES.items():
            table = getattr(lake, name)
            if table is None:
                table = self.spark.createDataFrame([], schema)
            table.write.parquet(f"{self.base}/catalog/{folder}/{name}")
        if self.version() != based_on:
            raise VersionTaken(f"version {version} of {self.base} is taken")
        self._claim(version)
        if attempt is None:
            self._list(version, batch, folder, attempt)
        else:
            self._commit(batch, attempt, folder, version)
        return version

    def not_yet_stored(self, plays: DataFrame, batch: str | None = None) -> DataFrame:
        """Plays of `plays` beyond what the lake holds already: a play the lake has m times and `plays` n times comes max(0, n - m) times.

        Only files of the (year, bucket) folders the new plays touch, and whose library bounds meet theirs, are read;
        earlier tries of `batch` do not count, as the import replaces them.  Equal plays are counted, not ranked, so a
        play repeated a third of all times moves one row a task.  Two overlapping imports at the same moment do not see
        each other's plays.
        """
        names = PLAYS.fieldNames()
        key = [F.xxhash64(*names).alias("_k1"), F.xxhash64(F.lit(1), *names).alias("_k2")]
        new = plays.select(*names).withColumns({"year": F.year("played_at_date"), "library_bucket": library_bucket(F.col("library"), self.buckets)})
        touched = new.groupBy("year", "library_bucket").agg(F.min("library").alias("lo"), F.max("library").alias("hi")).collect()
        listed = self.manifest.table()
        if touched:
            near = F.lit(False)
            for t in touched:
                same = F.col("year").eqNullSafe(F.lit(t["year"])) & (F.col("library_bucket") == t["library_bucket"])
                near = near | (same & ~(F.col("max_library") < F.lit(t["lo"])) & ~(F.col("min_library") > F.lit(t["hi"])))
            listed = listed.filter(near)
        paths = [r["path"] for r in listed.select("path").collect()] if touched else []
        stored = self.manifest.read_files(paths, STORED_PLAYS).withColumn("attempt", F.coalesce("attempt", "batch"))
        versions = self.versions()
        if batch is not None and versions is not None:
            gone = [r["attempt"] for r in versions.filter((F.col("batch") == batch) & F.col("attempt").isNotNull()).select("attempt").distinct().collect()]
            if gone:
                stored = stored.filter(~F.col("attempt").isin(gone))
        have = stored.select(*key).groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_m"))
        want = plays.select(*names, *key).groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in names])
        more = want.join(have, ["_k1", "_k2"], "left").withColumn("_more", F.col("_n") - F.coalesce("_m", F.lit(0))).filter("_more > 0")
        return more.select(*names, F.explode(F.sequence(F.lit(1), F.col("_more").cast("int"))).alias("_copy")).select(*names)

    def append_plays(self, plays: DataFrame, batch: str, dedupe: bool = False, commit: bool = True, overlap: bool = False) -> str:
        """Add plays under the name `batch`; doing it again replaces all of that batch, and only that.

        Each try has a folder name of its own, which is returned; readers see it once it is listed, here
        or (`commit=False`) with the catalog.

        Spark rebalances folders to even file sizes, so a folder that holds a
        third of the plays is written by many tasks.  Rows sort by library
        inside a file, which lets readers skip pages.  `dedupe` drops plays
        alike in every column.  `overlap` takes an export that may repeat plays already stored (a re-export that
        overlaps earlier ones): only what the lake does not hold yet is added, multiplicities kept.
        """
        attempt = uuid.uuid4().hex
        if dedupe:
            plays = plays.select(*PLAYS.fieldNames()).distinct()
        if overlap:
            plays = self.not_yet_stored(plays, batch)
        (
            plays.select(*PLAYS.fieldNames())
            .withColumns({
                "year": F.year("played_at_date"),
                "library_bucket": library_bucket(F.col("library"), self.buckets),
                "batch": F.lit(attempt),
            })
            .hint("rebalance", "year", "library_bucket")
            .sortWithinPartitions("year", "library_bucket", "library", "played_at_date")
            .write.mode("append")
            .partitionBy("year", "library_bucket", "batch").parquet(f"{self.base}/plays")
        )
        if commit:
            version = self.version()
            self._commit(batch, attempt, None, -1 if version is None else version)
        return attempt


def write_records(report: DataFrame, path: str) -> None:
    """A report as JSON records, nulls kept."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
