"""Lists per library are cut before the shuffle, also when longer than Spark's default threshold."""

from pyspark.sql import functions as F

from listenlake.operators.topk import top_k_per_group
from listenlake.session import SETTINGS


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_before_the_shuffle_for_short_and_long_lists(spark):
    threshold = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(threshold)
    spark.conf.set(threshold, SETTINGS[threshold])
    try:
        df = spark.range(20000).select((F.col("id") % 3).cast("string").alias("library"), F.col("id").alias("plays"), F.col("id").alias("isrc"))
        for limit in (10, 5000):
            ranked = top_k_per_group(df, "library", "plays", ["isrc"], limit)
            assert "WindowGroupLimit" in plan_of(ranked), limit
            assert ranked.groupBy("library").count().agg(F.max("count")).first()[0] == limit
    finally:
        spark.conf.set(threshold, old)
