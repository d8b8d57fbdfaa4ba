"""The store's manifest: readers open listed files only, compaction packs them, expiry removes replaced ones."""

import glob
import os

from pyspark.sql import functions as F

from listenlake.session import scratch_path
from listenlake.sources.store import STORED_PLAYS, LakeStore


def plays_of(spark, n, tag):
    rows = [(f"L{i % 7}", f"T{i % 13}", f"2020-0{1 + i % 9}-1{i % 10}", 1000 * i, tag) for i in range(n)]
    return spark.createDataFrame(rows, "library string, track_isrc string, day string, ms_played long, source string").selectExpr(
        "library", "track_isrc", "cast(day as date) as played_at_date", "'10:00' as played_at_time", "ms_played", "source")


def totals(store, library=None):
    return sorted(tuple(r) for r in store.read_plays(library).groupBy("library", "source").agg(F.count("*"), F.sum("ms_played")).collect())


def data_files(store):
    return [p for p in glob.glob(f"{store.base}/plays/**/*.parquet", recursive=True)]


def test_many_imports_compacted_and_expired(spark):
    store = LakeStore(spark, scratch_path(spark, "lake"), buckets=2).create()
    imports = 20
    for i in range(imports):
        store.append_plays(plays_of(spark, 30, f"s{i % 3}"), f"import-{i}")
    want = totals(store)
    assert sum(n for _, _, n, _ in want) == imports * 30
    many = len(data_files(store))
    before = store.manifest.newest()
    assert store.compact_plays(target_bytes=1 << 30) is not None
    # A reader that planned on the old manifest still finds every file, and so does a new one.
    old_files = [r["path"] for r in store.manifest.table(before).collect()]
    assert sorted(tuple(r) for r in store.manifest.read_files(old_files, STORED_PLAYS)
                  .groupBy("library", "source").agg(F.count("*"), F.sum("ms_played")).collect()) == want
    assert totals(store) == want
    live = store.manifest.table().count()
    assert live <= 2 * 9  # one a (year, bucket)
    # Importing a compacted batch again replaces its rows inside the packed files.
    store.append_plays(plays_of(spark, 5, "again"), "import-3")
    again = totals(store)
    assert sum(n for _, _, n, _ in again) == (imports - 1) * 30 + 5
    assert store.expire_files(keep=1, grace_seconds=0) > 0
    assert totals(store) == again
    assert len(data_files(store)) < many
    # Plays of one library come from the files of its bucket and bounds alone.
    assert totals(store, "L3") == [r for r in again if r[0] == "L3"]


def test_a_lake_without_manifest_is_read_and_taken_over(spark):
    store = LakeStore(spark, scratch_path(spark, "lake"), buckets=2)
    attempt = store.append_plays(plays_of(spark, 12, "x"), "old", commit=False)
    store._list(0, "old", None, attempt)  # listed as before manifests
    assert store.manifest.newest() is None
    assert sum(r[2] for r in totals(store)) == 12
    store.append_plays(plays_of(spark, 3, "y"), "new")
    assert sum(r[2] for r in totals(store)) == 15


def test_empty_imports(spark):
    store = LakeStore(spark, scratch_path(spark, "lake"), buckets=2).create()
    store.append_plays(plays_of(spark, 0, "x"), "nothing")
    assert totals(store) == [] and store.compact_plays() is None


def test_overlapping_exports_keep_every_play_once(spark):
    store = LakeStore(spark, scratch_path(spark, "lake"), buckets=2).create()
    base = plays_of(spark, 40, "x")
    twice = base.filter("ms_played between 10000 and 12000")
    first = base.filter("ms_played < 30000").unionByName(twice)
    second = base.filter("ms_played >= 10000").unionByName(twice).unionByName(twice)
    store.append_plays(first, "one", overlap=True)
    store.append_plays(second, "two", overlap=True)
    # Rows of `twice` are in `first` twice and in `second` three times: three copies in all.
    want = base.unionByName(twice).unionByName(twice)
    got = store.read_plays().select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # The same export again adds nothing, also after compaction; importing batch "two" again replaces its own plays.
    store.compact_plays(target_bytes=1 << 30)
    store.append_plays(second, "three", overlap=True)
    store.append_plays(second, "two", overlap=True)
    assert sorted(map(tuple, store.read_plays().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_commit_that_died_after_its_claim_does_not_block_the_next(spark):
    from listenlake.sources.manifest import files

    store = LakeStore(spark, scratch_path(spark, "lake"), buckets=2).create()
    seq = store.manifest.newest()[0]
    path, fs = files(spark)(f"{store.base}/claims/m{seq + 1}")
    fs.create(path, False).close()
    fs.setTimes(path, 0, 0)  # claimed long ago, never listed
    store.append_plays(plays_of(spark, 4, "x"), "after")
    assert store.manifest.newest()[0] == seq + 2 and sum(r[2] for r in totals(store)) == 4
