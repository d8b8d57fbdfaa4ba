"""Time the headline queries on a stored lake: prints one JSON line.

The lake is written once from the tables in $BENCH_SF_DIR; each report is then
run once to warm up and three times for the median.  Catalog jobs run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from listenlake.checks import raw
from listenlake.checks.catalog_checks import winners
from listenlake.checks.fixtures import lake, storable
from listenlake.operators.editions import merge_map
from listenlake.plans import details, imports, reports, search
from listenlake.session import build_session, scratch_path
from listenlake.sources import history
from listenlake.sources.store import LakeStore

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
START, END = "1996-03-01", "2000-06-30"


def run(df) -> None:
    """Compute every row without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    started = time.perf_counter()
    job()
    return time.perf_counter() - started


def report_jobs(lk) -> dict:
    artist, album = "S7", "Brand#2|ECONOMY"
    frames = {
        "general_stats": lambda: reports.general_stats(lk, START, END),
        "top_tracks": lambda: reports.top_tracks(lk, start=START, end=END),
        "top_artists": lambda: reports.top_artists(lk, start=START, end=END),
        "top_albums": lambda: reports.top_albums(lk, start=START, end=END),
        "top_tracks_of_library": lambda: reports.top_tracks(lk, library="L7"),
        "top_tracks_per_library": lambda: reports.top_tracks(lk, per_library=True),
        "artist_top_tracks": lambda: reports.artist_top_tracks(lk, artist),
        "artist_top_albums": lambda: reports.artist_top_albums(lk, artist),
        "album_tracks": lambda: reports.album_tracks(lk, album),
        "artist_stats": lambda: reports.artist_stats(lk, artist),
        "album_stats": lambda: reports.album_stats(lk, album),
        "search_tracks": lambda: search.search_tracks(lk, "household"),
        "search_artists": lambda: search.search_artists(lk, "0000001"),
        "search_albums": lambda: search.search_albums(lk, "live"),
        "search_all": lambda: details.search_all(lk, "live"),
        "artist_detail": lambda: details.artist_detail(lk, "Supplier#000000007"),
        "album_detail": lambda: details.album_detail(lk, "Brand#2"),
        "dashboard": lambda: details.dashboard(lk),
    }
    return {name: (lambda f=frame: run(f())) for name, frame in frames.items()}


def main() -> int:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    source = storable(lake(spark, SF_DIR))
    store = LakeStore(spark, scratch_path(spark, "lake"), buckets=4).create()

    def build() -> None:
        store.append_plays(source.plays, "bench")
        store.write_catalog(source, "bench")

    took["write_lake"] = timed(build)
    lk = store.read()
    for name, job in report_jobs(lk).items():
        job()
        took[name] = statistics.median(timed(job) for _ in range(RUNS))

    took["best_release"] = timed(lambda: run(winners(spark, SF_DIR)))
    took["merge_album_editions"] = timed(lambda: run(merge_map(lk.albums)))
    listens_a = history.normalize_a(raw.history_a(spark, SF_DIR), "me")
    listens_b = history.normalize_b(raw.history_b(spark, SF_DIR), "me")
    target = LakeStore(spark, scratch_path(spark, "import"), buckets=4)
    took["import_library"] = timed(lambda: imports.import_library(
        target, "bench", listens_a, listens_b, raw.metadata(spark, SF_DIR)
    ))

    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": {name: round(sec, 3) for name, sec in took.items()},
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    return 0


if __name__ == "__main__":
    sys.exit(main())
