"""Readers, writers, stream and import jobs against DuckDB.

Files are written by Spark from the driver's tables to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlake.checks import raw
from listenlake.checks.catalog_checks import merge_views
from listenlake.checks.fixtures import lake, storable, table
from listenlake.checks.registry import check
from listenlake.checks.report_checks import tracks_sql
from listenlake.operators.filters import long_enough
from listenlake.plans import imports, reports
from listenlake.schemas import CATALOG_TABLES, HISTORY_A, HISTORY_B
from listenlake.session import scratch_path
from listenlake.sources import history, metadata as meta_source
from listenlake.sources.store import LakeStore, write_records
from listenlake.streaming.append import append_stream

RAW_A = ", ".join(HISTORY_A.fieldNames())
RAW_B = ", ".join(f'"{name}"' for name in HISTORY_B.fieldNames())


@check("read_history_json", f"{raw.SQL} select {RAW_A} from raw_a")
def _(spark, sf_dir):
    path = scratch_path(spark, "exports")
    raw.write_history_files(raw.history_arrays(spark, sf_dir), path)
    return history.read_history_json(spark, path, name_glob="part-*").select(*HISTORY_A.fieldNames())


@check("read_history_workbook", f"{raw.SQL} select {RAW_B} from raw_b")
def _(spark, sf_dir):
    return history.unpack_workbooks(raw.workbooks(spark, sf_dir)).select(*HISTORY_B.fieldNames())


@check("read_history_archive", f"{raw.SQL} select {RAW_A} from raw_a")
def _(spark, sf_dir):
    files = history.unpack_archives(raw.archives(spark, sf_dir))
    return history.parse_history(files).select(*HISTORY_A.fieldNames())


@check("stage_input_files", """
, files as (
  select 'in/' || o_orderkey as path, o_custkey % 10 as length,
         case left(o_orderpriority, 1) when '1' then 'Streaming_History_Audio_' || o_custkey || '.json'
              when '2' then 'data_' || o_custkey || '.XLSX'
              when '3' then '._Streaming_History_Audio_' || o_custkey || '.json'
              when '4' then 'Streaming_History_Video_' || o_custkey || '.json'
              else 'Streaming_History_Audio_' || o_custkey || '.pdf' end as name
  from orders)
select min(path) as path, name, length from files
where not starts_with(name, '._') and (lower(name) like '%.xlsx'
      or (lower(name) like '%.json' and contains(name, 'Streaming_History_Audio')))
group by name, length""")
def _(spark, sf_dir):
    number = F.col("o_custkey").cast("string")
    kind = F.substring("o_orderpriority", 1, 1)
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("in/"), F.col("o_orderkey").cast("string")).alias("path"),
        (F.col("o_custkey") % 10).alias("length"),
        F.when(kind == "1", F.concat(F.lit("Streaming_History_Audio_"), number, F.lit(".json")))
        .when(kind == "2", F.concat(F.lit("data_"), number, F.lit(".XLSX")))
        .when(kind == "3", F.concat(F.lit("._Streaming_History_Audio_"), number, F.lit(".json")))
        .when(kind == "4", F.concat(F.lit("Streaming_History_Video_"), number, F.lit(".json")))
        .otherwise(F.concat(F.lit("Streaming_History_Audio_"), number, F.lit(".pdf"))).alias("name"),
    )
    return history.stage_input_files(files)


@check("load_track_metadata", f"""{raw.SQL}
, ids as (select distinct spotify_id from norm_a where spotify_id is not null)
select spotify_id, isrc, title, album_type, total_tracks from ids left join meta using (spotify_id)""")
def _(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    raw.metadata(spark, sf_dir).write.parquet(path)
    wanted = imports.first_seen(history.normalize_a(raw.history_a(spark, sf_dir)), "spotify_id")
    found = meta_source.candidates_by_id(wanted, meta_source.read_track_metadata(spark, path))
    return wanted.join(found.drop("seq"), "spotify_id", "left").select(
        "spotify_id", "isrc", "title", "album_type", "total_tracks"
    )


@check("metadata_candidates_by_isrc", f"""{raw.SQL}
, codes as (select distinct isrc from norm_b where isrc is not null)
select isrc, spotify_id, search_rank from codes join meta using (isrc)""")
def _(spark, sf_dir):
    wanted = imports.first_seen(history.normalize_b(raw.history_b(spark, sf_dir)), "isrc")
    return meta_source.candidates_by_isrc(wanted, raw.metadata(spark, sf_dir)).select(
        "isrc", "spotify_id", "search_rank"
    )


@check("metadata_isrc_match", f"""{raw.SQL}
select distinct n.isrc, m.album_id, m.album_type from norm_b n join meta m on m.isrc = n.isrc""")
def _(spark, sf_dir):
    wanted = imports.first_seen(history.normalize_b(raw.history_b(spark, sf_dir)), "isrc")
    return meta_source.candidates_by_isrc(wanted, raw.metadata(spark, sf_dir)).select(
        "isrc", "album_id", "album_type"
    )


def _new_store(spark) -> LakeStore:
    return LakeStore(spark, scratch_path(spark, "lake"), buckets=2)


def _stored(spark, sf_dir) -> LakeStore:
    """The fixture lake written as a stored one."""
    store = _new_store(spark).create()
    lk = storable(lake(spark, sf_dir))
    store.append_plays(lk.plays, "first")
    store.write_catalog(lk, "first")
    return store


@check("scan_library", """
select library, track_isrc, strftime(played_at_date, '%Y-%m-%d') as played_at_date, played_at_time, ms_played, source
from fx_plays where library = 'L7'""")
def _(spark, sf_dir):
    plays = _stored(spark, sf_dir).read("L7").plays
    return plays.select("library", "track_isrc", F.col("played_at_date").cast("string").alias("played_at_date"),
                        "played_at_time", "ms_played", "source")


@check("empty_library", """
select 'artists' as name, count(*) as n from fx_artists union all
select 'albums', count(*) from fx_albums union all select 'tracks', count(*) from fx_tracks union all
select 'track_features', count(*) from fx_track_features union all
select 'track_aliases', 0 union all select 'plays', count(*) from fx_plays""")
def _(spark, sf_dir):
    # Creating a lake where one exists leaves its tables as they are.
    lk = _stored(spark, sf_dir).create().read()
    return history.blend(*[
        getattr(lk, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name in (*CATALOG_TABLES, "plays")
    ])


@check("append_plays", """
select library, source, 2 * count(*) as plays, cast(2 * sum(ms_played) as bigint) as total_ms
from fx_plays group by library, source""")
def _(spark, sf_dir):
    # A second import doubles the plays; writing the same batch again changes nothing.
    store, plays = _stored(spark, sf_dir), lake(spark, sf_dir).plays
    store.append_plays(plays, "second")
    store.append_plays(plays, "second")
    return store.read().plays.groupBy("library", "source").agg(
        F.count("*").alias("plays"), F.sum("ms_played").alias("total_ms")
    )


@check("append_plays_deduped", """
select library, count(*) as plays, cast(sum(ms_played) as bigint) as total_ms
from (select distinct * from fx_plays) group by library""")
def _(spark, sf_dir):
    store = _new_store(spark).create()
    store.append_plays(lake(spark, sf_dir).plays, "first", dedupe=True)
    return store.read().plays.groupBy("library").agg(
        F.count("*").alias("plays"), F.sum("ms_played").alias("total_ms")
    )


#: Imports the compaction query splits the plays into.
IMPORTS = 12


@check("compact_plays", """
select library, source, count(*) as plays, cast(sum(ms_played) as bigint) as total_ms
from fx_plays group by library, source""")
def _(spark, sf_dir):
    # Many small imports, one of them twice; compacted into few files, replaced files expired; every play once.
    store = _new_store(spark).create()
    plays = lake(spark, sf_dir).plays
    part = F.pmod(F.xxhash64(*plays.columns), F.lit(IMPORTS))
    for i in range(IMPORTS):
        store.append_plays(plays.filter(part == i), f"import-{i}")
    store.compact_plays(target_bytes=1 << 30)
    store.append_plays(plays.filter(part == 0), "import-0")
    store.expire_files(keep=1, grace_seconds=0)
    return store.read().plays.groupBy("library", "source").agg(F.count("*").alias("plays"), F.sum("ms_played").alias("total_ms"))


@check("append_overlapping_export", """
select library, source, count(*) as plays, cast(sum(ms_played) as bigint) as total_ms
from fx_plays group by library, source""")
def _(spark, sf_dir):
    # Three quarters of the plays, then an export with two of those quarters again and the last one: every play once.
    store = _new_store(spark).create()
    plays = lake(spark, sf_dir).plays
    part = F.pmod(F.xxhash64(*plays.columns), F.lit(4))
    store.append_plays(plays.filter(part < 3), "export-1", overlap=True)
    store.append_plays(plays.filter(part > 0), "export-2", overlap=True)
    return store.read().plays.groupBy("library", "source").agg(F.count("*").alias("plays"), F.sum("ms_played").alias("total_ms"))


@check("report_as_json", tracks_sql())
def _(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = reports.top_tracks(lake(spark, sf_dir))
    write_records(report, path)
    return spark.read.schema(report.schema).json(path)


@check("stream_append_plays", """
select cast(user_id as varchar) as library, json_extract_string(props, '$.k') as track_isrc,
       strftime(ts, '%Y-%m-%d') as played_at_date, strftime(ts, '%H:%M') as played_at_time,
       cast(value * 1000 as bigint) as ms_played, event_type as source
from events where cast(value * 1000 as bigint) >= 30000""")
def _(spark, sf_dir):
    def to_plays(events):
        return long_enough(events.select(
            F.col("user_id").cast("string").alias("library"),
            F.get_json_object("props", "$.k").alias("track_isrc"),
            F.col("ts").cast("date").alias("played_at_date"),
            F.date_format("ts", "HH:mm").alias("played_at_time"),
            F.round(F.col("value") * 1000).cast("long").alias("ms_played"),
            F.col("event_type").alias("source"),
        ), strict=False)

    store = _new_store(spark)
    checkpoint = scratch_path(spark, "stream")
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf_dir)
    # The second run finds no new file.
    for _ in range(2):
        append_stream(rows, store, checkpoint, "events", to_plays)
    return store.read().plays.select(
        "library", "track_isrc", F.col("played_at_date").cast("string").alias("played_at_date"),
        "played_at_time", "ms_played", "source",
    )


IMPORTED = f"""{raw.SQL}
, ids as (
  select spotify_id, min((file, pos)) as seq from norm_a where spotify_id is not null
  group by spotify_id),
cand_a as (select m.*, i.seq from ids i join meta m using (spotify_id)),
win_a as (
  select *, min(seq) over (partition by isrc) as first_seq from cand_a
  qualify row_number() over (partition by isrc order by score desc, total_tracks desc, seq) = 1),
alb_a as (
  select album_id as id, arg_min(album_name, first_seq) as name, arg_min(artist_id, first_seq) as artist_id,
         arg_min(album_type, first_seq) as album_type, (0, min(first_seq)) as seq
  from win_a group by album_id),
known as (select w.isrc, a.album_type from win_a w join alb_a a on a.id = w.album_id),
codes as (select isrc, min((file, pos)) as seq from norm_b where isrc is not null group by isrc),
cand_b as (
  select m.*, c.seq as first_seq, k.isrc is not null as is_upgrade,
         case k.album_type when 'album' then 3 when 'compilation' then 2 when 'single' then 1 else 0 end as old_score
  from codes c left join known k on k.isrc = c.isrc join meta m on m.isrc = c.isrc
  where k.album_type is distinct from 'album'),
win_b as (
  select * from (
    select * from cand_b
    qualify row_number() over (partition by isrc order by score desc, total_tracks desc, search_rank) = 1)
  where not is_upgrade or score > old_score),
in_tracks as (
  select a.isrc, a.artist_id, coalesce(b.title, a.title) as title, coalesce(b.album_id, a.album_id) as album_id,
         coalesce(b.duration_ms, a.duration_ms) as duration_ms, coalesce(b.spotify_id, a.spotify_id) as spotify_id
  from win_a a left join win_b b on b.isrc = a.isrc
  union all
  select isrc, artist_id, title, album_id, duration_ms, spotify_id from win_b where not is_upgrade),
in_albums as (
  select * from alb_a union all
  select album_id, arg_min(album_name, first_seq), arg_min(artist_id, first_seq), arg_min(album_type, first_seq),
         (1, min(first_seq))
  from win_b where album_id not in (select id from alb_a) group by album_id),
{merge_views('in_albums').strip()},
in_plays as (
  select m.isrc as track_isrc, 'Spotify' as source, ms_played
  from norm_a left join meta m using (spotify_id) where spotify_id is not null
  union all
  select isrc, 'Deezer', ms_played from norm_b where isrc in (select isrc from in_tracks))
select t.isrc, title, artist_id, coalesce(master_id, t.album_id) as album_id, duration_ms, spotify_id,
       (select count(*) from in_albums) - (select count(*) from merges) as n_albums,
       count(p.track_isrc) filter (source = 'Spotify') as plays_a,
       count(p.track_isrc) filter (source = 'Deezer') as plays_b,
       cast(coalesce(sum(p.ms_played), 0) as bigint) as total_ms
from in_tracks t left join merges m on m.album_id = t.album_id left join in_plays p on p.track_isrc = t.isrc
group by all"""


def _exports(spark, sf_dir):
    """Both platforms' exports, whole."""
    return history.normalize_a(raw.history_a(spark, sf_dir), "me"), history.normalize_b(raw.history_b(spark, sf_dir), "me")


@check("import_library", IMPORTED, recursive=True)
def _(spark, sf_dir):
    store = _new_store(spark)
    a, b = _exports(spark, sf_dir)
    lk = imports.import_library(store, "both", a, b, raw.metadata(spark, sf_dir))
    played = lk.plays.groupBy(F.col("track_isrc").alias("isrc")).agg(
        F.count_if(F.col("source") == "Spotify").alias("plays_a"),
        F.count_if(F.col("source") == "Deezer").alias("plays_b"), F.sum("ms_played").alias("total_ms"),
    )
    zero = F.lit(0).cast("long")
    return lk.tracks.join(played, "isrc", "left").select(
        "isrc", "title", "artist_id", "album_id", "duration_ms", "spotify_id",
        lk.albums.agg(F.count("*")).scalar().alias("n_albums"),
        *[F.coalesce(c, zero).alias(c) for c in ("plays_a", "plays_b", "total_ms")],
    )


@check("append_library", f"""{raw.SQL}
, in_plays as (
  select m.isrc as track_isrc, 'Spotify' as source, ms_played
  from norm_a left join meta m using (spotify_id) where spotify_id is not null
  union all
  select isrc, 'Deezer', ms_played from norm_b where isrc is not null)
select track_isrc, source, count(*) as plays, cast(sum(ms_played) as bigint) as total_ms
from in_plays group by track_isrc, source""")
def _(spark, sf_dir):
    # The later import resolves ids of the earlier one too; doing it again adds nothing.
    store, found = _new_store(spark), raw.metadata(spark, sf_dir)
    finished = F.col("part") == "F"
    lines, b = raw.history_a(spark, sf_dir), _exports(spark, sf_dir)[1]
    imports.import_library(store, "first", history.normalize_a(lines.filter(finished), "me"), None, found)
    for _ in range(2):
        lk = imports.import_library(store, "second", history.normalize_a(lines.filter(~finished), "me"), b, found)
    return lk.plays.groupBy("track_isrc", "source").agg(
        F.count("*").alias("plays"), F.sum("ms_played").alias("total_ms")
    )
