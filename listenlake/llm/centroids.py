"""Centroid clustering with an incremental distance matrix of exact integers.

Vectors of exactly DIM components, none null or non-finite, are kept and scaled to
integers floor(SCALE * x), x taken as double.  Centroids 0 .. K-1 start as the K kept
vectors with the smallest hex sha256 of `<SEED>:<vec_id>` (ties: smaller components),
in that order.  Each of ROUNDS rounds assigns every vector to its nearest centroid
(squared Euclidean distance, ties to the smaller number) and replaces every centroid
that got vectors by the componentwise floor(sum / count) of them; then vectors are
assigned once more.

Method: every vector keeps its exact dot products with all centroids in a stored table.
A round changes a centroid by a few components; the dot products are updated by those
nonzero changes alone (x . c' = x . c + sum of x_i * (c'_i - c_i) over changed i), and the
nearest centroid is the argmin of |c|^2 - 2 x . c.  The sums per centroid are partial
aggregates of K rows a task, so a centroid that draws a third of all vectors moves no more
than the others; only those K x DIM sums reach the driver.  Each round's table is written
below the shared folder and the one before it removed, so a lost executor costs one round.

Rows: vectors with another length, a null or non-finite component, a null vector, or a
scaled component beyond +-LIMIT (exact long arithmetic needs |x| < 2^28 / SCALE) are not
kept and get no row.  Rows that repeat, ids included, are kept each; equal vectors tie and
go to the smaller centroid.  With fewer than K kept vectors there are as many centroids; an
empty table gives no rows.  Extra columns of the input stay; result columns replace
columns of the same names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.session import scratch_path

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Scaled components lie within +-LIMIT, so that DIM products of two of them fit a long.
LIMIT = 1 << 28
_X, _NORM, _DOTS = "_cc_x", "_cc_norm", "_cc_dots"
RESULT = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def scaled_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Kept rows with `_cc_x` (DIM ints), `_cc_norm` (|x|^2) and the hash that picks first centroids."""
    e = F.col(column)
    fits = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < LIMIT))
    kept = vectors.filter(F.coalesce((F.size(e) == DIM) & fits, F.lit(False)))
    x = F.transform(e, lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    kept = kept.drop(*RESULT).withColumn(_X, x)
    return kept.withColumn(_NORM, F.aggregate(_X, F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long") * v))


def first_centroids(kept: DataFrame, k: int = K) -> list[list[int]]:
    """The K vectors of smallest sha256('SEED:vec_id'): K rows reach the driver."""
    picked = kept.select(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256).alias("h"), _X)
    return [list(r[_X]) for r in picked.orderBy(F.col("h").asc_nulls_last(), _X).limit(k).collect()]


def dot_update(dots: Column, x: Column, changes: list[dict[int, int]]) -> Column:
    """Dot products after centroids changed by `changes` (component -> change), from the nonzero changes alone."""
    updated = []
    for j, change in enumerate(changes):
        value = F.element_at(dots, j + 1)
        for i, d in sorted(change.items()):
            value = value + F.get(x, i).cast("long") * F.lit(d)
        updated.append(value)
    return F.array(*updated)


def nearest(dots: Column, centroids: list[list[int]]) -> Column:
    """The number of the nearest centroid: argmin of |c|^2 - 2 x . c, ties to the smaller."""
    norms = [sum(v * v for v in c) for c in centroids]
    costs = F.array(*[F.lit(n) - 2 * F.element_at(dots, j + 1) for j, n in enumerate(norms)])
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def _remove(spark, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _new_centroids(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the mean of each centroid's vectors; centroids without vectors stay."""
    sums = table.groupBy(nearest(F.col(_DOTS), centroids).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get(F.col(_X), i).cast("long")).alias(f"s{i}") for i in range(DIM)]
    ).collect()
    new = [list(c) for c in centroids]
    for row in sums:
        new[row["c"]] = [row[f"s{i}"] // row["n"] for i in range(DIM)]
    return new


def cluster_vectors(vectors: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """Kept rows of `vectors` with cluster, distance (squared), cluster_inertia, inertia and centroid_sha256; and the centroids."""
    spark = vectors.sparkSession
    # Caller's columns named like the working ones are carried under other names and given back.
    aside = {c: f"{c}_{abs(hash(c)) % 10**6}_kept" for c in vectors.columns if c in (_X, _NORM, _DOTS)}
    for c, name in aside.items():
        vectors = vectors.withColumnRenamed(c, name)
    kept = scaled_vectors(vectors, column)
    table = kept.withColumn(_DOTS, F.array(*[F.lit(0).cast("long")] * k))
    centroids = first_centroids(kept, k)
    if not centroids:
        empty = table.drop(_X, _NORM, _DOTS)
        for c, name in aside.items():
            empty = empty.withColumnRenamed(name, c)
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(RESULT, ["int", "long", "long", "long", "string"])]), []
    table = table.withColumn(_DOTS, F.slice(_DOTS, 1, len(centroids)))
    before = [[0] * DIM for _ in centroids]
    stored = None
    for round_ in range(rounds + 1):
        changes = [{i: b - a for i, (a, b) in enumerate(zip(old, new)) if b != a} for old, new in zip(before, centroids)]
        if any(changes) or stored is None:
            # The round's dot products are stored; the table before is no longer read.
            path = scratch_path(spark, "centroid-dots")
            updated = table.withColumn(_DOTS, dot_update(F.col(_DOTS), F.col(_X), changes))
            updated.write.parquet(path)
            table = spark.read.schema(updated.schema).parquet(path)
            if stored:
                _remove(spark, stored)
            stored = path
        if round_ == rounds:
            break
        before, centroids = centroids, _new_centroids(table, centroids)
    cluster = nearest(F.col(_DOTS), centroids)
    norms = [sum(v * v for v in c) for c in centroids]
    assigned = table.withColumn("cluster", cluster).withColumn(
        "distance", F.col(_NORM) + F.element_at(F.array(*[F.lit(n) for n in norms]), F.col("cluster") + 1) - 2 * F.element_at(F.col(_DOTS), F.col("cluster") + 1)
    )
    per = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest() for c in centroids]
    inertia = sum(per.values())
    by_cluster = F.array(*[F.lit(per.get(j, 0)).cast("long") for j in range(len(centroids))])
    result = assigned.select(
        *[c for c in table.columns if c not in (_X, _NORM, _DOTS)], "cluster", "distance",
        F.element_at(by_cluster, F.col("cluster") + 1).alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("cluster") + 1).alias("centroid_sha256"),
    )
    for c, name in aside.items():
        result = result.withColumnRenamed(name, c)
    return result, centroids
