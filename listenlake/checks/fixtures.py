"""Listening history seen through the driver's test tables.

Spark and DuckDB build the same views; FIXTURES.md explains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listenlake.lake import Lake
from listenlake.operators.filters import long_enough


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read with its known schema so that no job has to look it up."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str):
    return F.col(column).cast("string")


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    performers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), _text("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_suppkey").alias("seq"),
    )
    ensembles = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), _text("n_nationkey")).alias("id"),
        F.col("n_name").alias("name"),
        (-1 - F.col("n_nationkey").cast("long")).alias("seq"),
    )
    return performers.unionByName(ensembles)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_performers = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    songs = table(spark, sf_dir, "part").select(
        _text("p_partkey").alias("isrc"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("S"), (F.col("p_partkey") % n_performers).cast("string")).alias("artist_id"),
        F.concat_ws("|", "p_brand", "p_type").alias("album_id"),
        (F.col("p_size") * 10000).cast("long").alias("duration_ms"),
        F.concat(F.lit("sp"), _text("p_partkey")).alias("spotify_id"),
    )
    demos = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), _text("c_custkey")).alias("isrc"),
        F.concat(F.col("c_mktsegment"), F.lit(" demo")).alias("title"),
        F.concat(F.lit("N"), _text("c_nationkey")).alias("artist_id"),
        F.concat(F.lit("C"), _text("c_custkey")).alias("album_id"),
        F.lit(180000).cast("long").alias("duration_ms"),
        F.concat(F.lit("spC"), _text("c_custkey")).alias("spotify_id"),
    )
    return songs.unionByName(demos)


def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distinct as numbers, which are smaller than their texts; each number has a text of its own.
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().select(
        _text("l_partkey").alias("track_isrc"),
        F.concat(F.lit("S"), _text("l_suppkey")).alias("artist_id"),
    )


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    edition = (
        F.when(F.col("p_type") == "ECONOMY", "")
        .when(F.col("p_type") == "SMALL", " (Deluxe Edition)")
        .when(F.col("p_type") == "MEDIUM", " Remastered")
        .when(F.col("p_type") == "PROMO", " Live")
        .when(F.col("p_type") == "STANDARD", " Vol. 2")
        .otherwise(" Deluxe Live")
    )
    song_albums = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_partkey").alias("seq")
    ).select(
        F.concat_ws("|", "p_brand", "p_type").alias("id"),
        F.concat(F.col("p_brand"), edition).alias("name"),
        F.concat(F.lit("S"), (F.substring("p_brand", 7, 10).cast("int") % 5).cast("string")).alias("artist_id"),
        F.when(F.col("p_type") == "PROMO", "compilation").when(F.col("p_type") == "SMALL", "single")
        .otherwise("album").alias("album_type"),
        "seq",
    )
    kind = F.col("c_custkey") % 6
    demo_edition = (
        F.when(kind == 0, "")
        .when(kind == 1, " (Deluxe Edition)")
        .when(kind == 2, F.concat(F.lit(" Vol. "), _text("c_custkey")))
        .when(kind == 3, " Live")
        .when(kind == 4, F.concat(F.lit(" "), _text("c_custkey")))
        .otherwise(" Live Remastered")
    )
    demo_albums = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), _text("c_custkey")).alias("id"),
        F.concat(F.col("c_mktsegment"), demo_edition).alias("name"),
        F.concat(F.lit("N"), _text("c_nationkey")).alias("artist_id"),
        F.when(kind == 0, "album").when(kind == 1, "compilation").otherwise("single").alias("album_type"),
        (-1 - F.col("c_custkey")).alias("seq"),
    )
    return song_albums.unionByName(demo_albums)


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as one listen, before the minimum-time rule."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, _text("l_partkey")).alias("track_isrc"),
        F.col("l_shipdate").cast("date").alias("played_at_date"),
        F.lit("00:00").alias("played_at_time"),
        (F.col("l_quantity") * 10000).cast("long").alias("ms_played"),
        F.when(F.col("l_returnflag") == "A", "Spotify").otherwise("Deezer").alias("source"),
        F.concat(F.lit("L"), _text("l_suppkey")).alias("library"),
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_enough(heard(spark, sf_dir), strict=False)


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    return Lake(
        artists=artists(spark, sf_dir),
        albums=albums(spark, sf_dir),
        tracks=tracks(spark, sf_dir),
        track_features=track_features(spark, sf_dir),
        plays=plays(spark, sf_dir),
    )


def storable(lake: Lake) -> Lake:
    """The lake with arrival in the stored shape."""
    def arrival(df: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.withColumn("seq", F.struct(
            zero.alias("batch"), F.lit("").alias("file"), F.col("seq").alias("pos"), zero.alias("item")
        ))

    return lake.with_tables(artists=arrival(lake.artists), albums=arrival(lake.albums))


# The same views as DuckDB text.
SQL = """
fx_artists as (
  select 'S' || s_suppkey as id, s_name as name, s_suppkey as seq from supplier
  union all
  select 'N' || n_nationkey, n_name, -1 - cast(n_nationkey as bigint) from nation),
fx_tracks as (
  select cast(p_partkey as varchar) as isrc, p_name as title,
         'S' || (p_partkey % (select count(*) from supplier)) as artist_id,
         p_brand || '|' || p_type as album_id, cast(p_size * 10000 as bigint) as duration_ms,
         'sp' || p_partkey as spotify_id
  from part
  union all
  select 'C' || c_custkey, c_mktsegment || ' demo', 'N' || c_nationkey, 'C' || c_custkey,
         cast(180000 as bigint), 'spC' || c_custkey
  from customer),
fx_track_features as (
  select distinct cast(l_partkey as varchar) as track_isrc, 'S' || l_suppkey as artist_id from lineitem),
fx_albums as (
  select p_brand || '|' || p_type as id,
         p_brand || case p_type when 'ECONOMY' then ''
                                when 'SMALL' then ' (Deluxe Edition)'
                                when 'MEDIUM' then ' Remastered'
                                when 'PROMO' then ' Live'
                                when 'STANDARD' then ' Vol. 2'
                                else ' Deluxe Live' end as name,
         'S' || (cast(substr(p_brand, 7) as int) % 5) as artist_id,
         case p_type when 'PROMO' then 'compilation' when 'SMALL' then 'single' else 'album' end as album_type,
         min(p_partkey) as seq
  from part group by p_brand, p_type
  union all
  select 'C' || c_custkey,
         c_mktsegment || case c_custkey % 6 when 0 then ''
                                            when 1 then ' (Deluxe Edition)'
                                            when 2 then ' Vol. ' || c_custkey
                                            when 3 then ' Live'
                                            when 4 then ' ' || c_custkey
                                            else ' Live Remastered' end,
         'N' || c_nationkey,
         case c_custkey % 6 when 0 then 'album' when 1 then 'compilation' else 'single' end,
         -1 - c_custkey
  from customer),
fx_heard as (
  select case when l_linenumber <> 7 then cast(l_partkey as varchar) end as track_isrc,
         cast(l_shipdate as date) as played_at_date, '00:00' as played_at_time,
         cast(l_quantity * 10000 as bigint) as ms_played,
         case l_returnflag when 'A' then 'Spotify' else 'Deezer' end as source,
         'L' || l_suppkey as library
  from lineitem),
fx_plays as (select * from fx_heard where ms_played >= 30000)
"""


def with_views(query: str, recursive: bool = False) -> str:
    """A DuckDB statement over the fixture views; `query` may go on with more views."""
    return f"with {'recursive ' if recursive else ''}{SQL.strip()}\n{query.strip()}"
