"""Who is credited on a track: shared by most reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.lake import Lake
from listenlake.operators.lists import SUMS, list_numbers, sum_lists
from listenlake.operators.topk import number_rows
from listenlake.session import batches_by_rows, cut_lineage, tasks_for

#: A library of more plays is summed by artist before its rows meet; so no task gets one whole.
LARGE_LIBRARY = 1_000_000


def all_artists(lake: Lake) -> DataFrame:
    """(track_isrc, artist_id), each pair once even when an artist features on their own track."""
    main = lake.tracks.select(F.col("isrc").alias("track_isrc"), "artist_id")
    return main.unionByName(lake.track_features.select("track_isrc", "artist_id")).distinct()


def number_artists(pairs: DataFrame) -> DataFrame:
    """(artist_id, artist_no): the distinct artists of `pairs`, numbered from 1 in the order of their ids, stored."""
    return cut_lineage(number_rows(pairs.select("artist_id").distinct(), ["artist_id"]).select(
        "artist_id", F.col("rank").cast("int").alias("artist_no")))


def per_library_artist(lake: Lake, rolled: DataFrame, numbers: DataFrame,
                       by: str = "total_ms", limit: int = -1) -> DataFrame:
    """(library, artist_no, total_ms, play_count) of per-track rows by library; every credited artist gets the full totals.

    A library's recordings lie in all tasks of the join with the credits, so sums by artist would leave that join
    nearly one row per recording and artist.  Each recording carries its artists as one short array of numbers to
    its library instead, and is unfolded there: rows arrive sorted by library, and workers hold the sums of one
    library, not of all that a task gets.  The few libraries too large for a task (at most one for every
    `LARGE_LIBRARY` plays) are summed by artist on both sides of the shuffle.

    With a `limit` over 0 the libraries that fit a task come with their `limit` largest sums in `by` only, ties by
    number; these are stored.
    """
    sizes = cut_lineage(lake.plays.groupBy("library").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = [r["library"] for r in sizes.filter(F.col("n") > LARGE_LIBRARY).collect()]
    # Libraries without a name are one library too.
    is_large = F.coalesce(F.col("library").isin([x for x in large if x is not None]), F.lit(None in large))
    numbered = lake.tracks.select(F.col("isrc").alias("track_isrc"), "artist_id").unionByName(
        lake.track_features.select("track_isrc", "artist_id")
    ).dropna(subset=["track_isrc"]).withColumnRenamed("artist_id", "_id").join(
        numbers, F.col("_id").eqNullSafe(F.col("artist_id"))
    ).select("track_isrc", "artist_no")
    # A recording's pairs are made distinct and listed where they meet; a single number as key sorts faster than text.
    spark = lake.plays.sparkSession
    with batches_by_rows(spark):
        listed = cut_lineage(numbered.repartition("track_isrc").withColumn("_hash", F.xxhash64("track_isrc")).sortWithinPartitions(
            "_hash").mapInArrow(list_numbers, "track_isrc string, artists array<int>"))
    # Rows of plays need no sort for a join with the few lists of a recording.
    joined = rolled.select("library", "track_isrc", "total_ms", "play_count").join(
        listed.hint("shuffle_hash"), "track_isrc").drop("track_isrc")
    few = joined.filter(~is_large) if large else joined
    dealt = few.select("library", "artists", "total_ms", "play_count").repartition(
        tasks_for(spark, total), "library").sortWithinPartitions("library")
    out = dealt.mapInArrow(partial(sum_lists, by, limit), f"library string, sums {SUMS}")
    if limit > 0:
        with batches_by_rows(spark):
            out = cut_lineage(out)
    out = out.select("library", F.inline("sums"))
    if not large:
        return out
    unfolded = joined.filter(is_large).select("library", F.explode("artists").alias("artist_no"), "total_ms", "play_count")
    return out.unionByName(unfolded.groupBy("library", "artist_no").agg(
        F.sum("total_ms").alias("total_ms"), F.sum("play_count").alias("play_count")))


def tracks_of_artist(lake: Lake, artist_id: str) -> DataFrame:
    """(track_isrc) of one artist; the key reaches both scans, only its own credits are shuffled."""
    main = lake.tracks.filter(F.col("artist_id") == artist_id).select(F.col("isrc").alias("track_isrc"))
    features = lake.track_features.filter(F.col("artist_id") == artist_id).select("track_isrc")
    return main.unionByName(features).distinct()


def credit_names(lake: Lake) -> DataFrame:
    """(isrc, ord, artist_id, name): main artist first, features after, repeats kept; unknown artists drop."""
    main = lake.tracks.select("isrc", F.lit(0).alias("ord"), "artist_id")
    features = lake.track_features.select(
        F.col("track_isrc").alias("isrc"), F.lit(1).alias("ord"), "artist_id"
    )
    names = lake.artists.select(F.col("id").alias("artist_id"), "name")
    return main.unionByName(features).join(names, "artist_id").select("isrc", "ord", "artist_id", "name")


def join_names(credits: Column) -> Column:
    """Aggregate of (ord, artist_id, name) structs as `main, feature, feature`.

    Features sort by artist id; null structs are skipped; no credit gives null.
    A group is one track's credits, which came from the artist list of a single
    metadata row.
    """
    names = F.transform(F.sort_array(F.collect_list(credits)), lambda c: c["name"])
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def display_names(lake: Lake) -> DataFrame:
    """(isrc, artist): the credited names of every track in one string."""
    return credit_names(lake).groupBy("isrc").agg(
        join_names(F.struct("ord", "artist_id", "name")).alias("artist")
    )


def with_display_names(lake: Lake, ranked: DataFrame, artist_display: str = "all", repeated: bool = False) -> DataFrame:
    """Add `artist` to rows that carry `isrc` and `artist_id`; no credits give null.

    Only the credits of these rows are looked up, once for each recording, and joined back.  A list that
    may hold a recording many times (`repeated`) is stored first: a hit that is in the lists of all
    libraries is one row where its credits meet, and Spark may split or broadcast the sides of the last
    join.  Any other list has a recording once, and both ways into the join read one exchange.
    `artist_display="main"` names the main artist only.
    """
    if artist_display == "main":
        names = lake.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist"))
        return ranked.join(names, "artist_id", "left")
    ranked = cut_lineage(ranked) if repeated else ranked.repartition("isrc")
    # All columns stay on both ways, so that the exchange below is one.
    listed = ranked.select("isrc", "artist_id").distinct() if repeated else ranked
    features = lake.track_features.select(
        F.col("track_isrc").alias("isrc"), F.col("artist_id").alias("credit_id")
    )
    payload = listed.columns
    credits = listed.select(*payload, F.lit(0).alias("ord"), F.col("artist_id").alias("credit_id")).unionByName(
        listed.join(features, "isrc").select(*payload, F.lit(1).alias("ord"), "credit_id")
    )
    names = lake.artists.select(F.col("id").alias("credit_id"), F.col("name").alias("credit_name"))
    credit = F.struct("ord", "credit_id", F.col("credit_name").alias("name"))
    shown = credits.join(names, "credit_id", "left").groupBy(*payload).agg(
        join_names(F.when(F.col("credit_name").isNotNull(), credit)).alias("artist")
    )
    return ranked.join(shown.drop("artist_id"), "isrc", "left") if repeated else shown
