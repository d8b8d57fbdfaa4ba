"""Release choice, catalog changes and edition merges against DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlake.checks import raw
from listenlake.checks.fixtures import lake, storable, table
from listenlake.checks.operator_checks import edition_match
from listenlake.checks.registry import check
from listenlake.lake import Lake
from listenlake.operators import editions, releases
from listenlake.session import scratch_path
from listenlake.sources.store import LakeStore

TRACK_COLUMNS = ["isrc", "title", "artist_id", "album_id", "duration_ms", "spotify_id"]

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]


@check("best_release", f"""
, candidates as (
  select *, case l_linenumber % 4 when 0 then 'album' when 1 then 'compilation' when 2 then 'single'
                                  else 'other' end as album_type,
         case l_linenumber % 4 when 0 then 3 when 1 then 2 when 2 then 1 else 0 end as score
  from lineitem)
select cast(l_partkey as varchar) as isrc, album_type, cast(l_quantity as bigint) as total_tracks, l_orderkey,
       l_linenumber, l_extendedprice, min(l_orderkey) over (partition by l_partkey) as first_order
from candidates
qualify row_number() over (partition by l_partkey order by score desc, l_quantity desc, {', '.join(LINE_ORDER)}) = 1""")
def _(spark, sf_dir):
    kind = F.col("l_linenumber") % 4
    candidates = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("isrc"),
        F.when(kind == 0, "album").when(kind == 1, "compilation").when(kind == 2, "single").otherwise("other")
        .alias("album_type"),
        F.col("l_quantity").cast("long").alias("total_tracks"),
        F.struct(*LINE_ORDER).alias("seq"),
    )
    return releases.best_release(candidates).select(
        "isrc", "album_type", "total_tracks", "seq.l_orderkey", "seq.l_linenumber", "seq.l_extendedprice",
        F.col("first_seq.l_orderkey").alias("first_order"),
    )


@check("insert_or_ignore", """
, incoming as (
  select 'S' || (l_suppkey * 2) as id,
         case when l_discount <> 0 then 'Line ' || l_orderkey || '-' || l_linenumber end as name,
         l_orderkey * 8 + l_linenumber as seq from lineitem)
select id, name, seq from fx_artists union all
select id, arg_min(name, seq), min(seq) from incoming
where name is not null and id not in (select id from fx_artists) group by id""")
def _(spark, sf_dir):
    incoming = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") * 2).cast("string")).alias("id"),
        F.when(F.col("l_discount") != 0, F.concat_ws(
            "-", F.concat(F.lit("Line "), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")
        )).alias("name"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    return releases.insert_or_ignore(lake(spark, sf_dir).artists, incoming, ["id"], ["name"], "seq")


def winners(spark, sf_dir):
    """Best release per code, first seen in the order of the platform ids."""
    flat = releases.flatten_metadata(raw.metadata(spark, sf_dir))
    zero = F.lit(0).cast("long")
    return releases.best_release(flat.withColumn("seq", F.struct(
        zero.alias("batch"), F.lit("").alias("file"),
        F.col("isrc").cast("long") * 4 + F.col("search_rank"), zero.alias("item"),
    ).cast("struct<batch:bigint,file:string,pos:bigint,item:bigint>")))


WINNERS = f"""{raw.SQL}
, ordered as (select *, cast(isrc as bigint) * 4 + search_rank as pos from meta),
winners as (
  select *, min(pos) over (partition by isrc) as first_pos from ordered
  qualify row_number() over (partition by isrc order by score desc, total_tracks desc, pos) = 1),
winner_albums as (
  select album_id as id, arg_min(album_name, first_pos) as name, arg_min(artist_id, first_pos) as artist_id,
         arg_min(album_type, first_pos) as album_type
  from winners group by album_id)"""


def _catalog_rows(lk: Lake):
    """All catalog tables in one frame of text."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    parts = [
        lk.artists.select(F.lit("artist").alias("kind"), "id", F.col("name").alias("a"), none.alias("b"),
                          none.alias("c"), none.alias("d")),
        lk.albums.select(F.lit("album"), "id", "name", "artist_id", "album_type", none),
        lk.tracks.select(F.lit("track"), "isrc", "title", "artist_id", "album_id",
                         F.concat_ws("/", text("duration_ms"), "spotify_id")),
        lk.track_features.select(F.lit("feature"), "track_isrc", "artist_id", none, none, none),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


@check("catalog_from_metadata", f"""{WINNERS}
, people as (
  select artist_id as id, artist_name as name from winners
  union select low_id, 'Singer ' || low from winners union select high_id, 'Singer ' || high from winners)
select 'artist' as kind, id, name as a, null as b, null as c, null as d from people union all
select 'album', id, name, artist_id, album_type, null from winner_albums union all
select 'track', isrc, title, artist_id, album_id, duration_ms || '/' || spotify_id from winners union all
select distinct 'feature', isrc, unnest([low_id, high_id, artist_id]), null, null, null from winners""")
def _(spark, sf_dir):
    return _catalog_rows(releases.add_winners(LakeStore(spark, scratch_path(spark, "lake")).empty(), winners(spark, sf_dir)))


@check("upgrade_release", f"""{WINNERS}
, stored as (
  select t.* from fx_tracks t join fx_albums al on al.id = t.album_id where al.album_type <> 'compilation'),
known as (select t.isrc, al.album_type from stored t join fx_albums al on al.id = t.album_id),
better as (
  select w.*, k.isrc is not null as is_upgrade from winners w left join known k on k.isrc = w.isrc
  where k.isrc is null
     or w.score > case k.album_type when 'album' then 3 when 'compilation' then 2 when 'single' then 1 else 0 end),
merged as (
  select t.isrc, case when b.isrc is null then t.title else b.title end as title, t.artist_id,
         coalesce(b.album_id, t.album_id) as album_id, coalesce(b.duration_ms, t.duration_ms) as duration_ms,
         coalesce(b.spotify_id, t.spotify_id) as spotify_id
  from stored t left join better b on b.isrc = t.isrc and b.is_upgrade
  union all
  select isrc, title, artist_id, album_id, duration_ms, spotify_id from better where not is_upgrade),
people as (
  select id, name from fx_artists union all
  select id, any_value(name) from (
    select artist_id as id, artist_name as name from better
    union select low_id, 'Singer ' || low from better where not is_upgrade
    union select high_id, 'Singer ' || high from better where not is_upgrade)
  where id not in (select id from fx_artists) group by id),
features as (
  select track_isrc, artist_id from fx_track_features union
  select isrc, unnest([low_id, high_id, artist_id]) from better where not is_upgrade)
select 'artist' as kind, id, name as a, null as b, null as c, null as d from people union all
select 'album', id, name, artist_id, album_type, null from fx_albums union all
select 'album', album_id, arg_min(album_name, first_pos), arg_min(artist_id, first_pos),
       arg_min(album_type, first_pos), null from better group by album_id union all
select 'track', isrc, title, artist_id, album_id, duration_ms || '/' || spotify_id from merged union all
select 'feature', track_isrc, artist_id, null, null, null from features""")
def _(spark, sf_dir):
    lk = storable(lake(spark, sf_dir))
    compilations = lk.albums.filter("album_type = 'compilation'").select(F.col("id").alias("album_id"))
    lk = lk.with_tables(tracks=lk.tracks.join(compilations, "album_id", "left_anti").select(*TRACK_COLUMNS))
    better = releases.upgrades_only(winners(spark, sf_dir), releases.catalog_album_types(lk))
    return _catalog_rows(releases.upgrade_release(lk, better))


def merge_views(albums: str) -> str:
    """(album_id, master_id) in `merges`, one album of each artist per step."""
    return f"""
pos as (
  select artist_id, id, lower(name) as nm,
         row_number() over (partition by artist_id order by length(name) desc, seq, id) as rn from {albums}),
earlier as (
  select b.artist_id, b.rn, list(a.rn order by a.rn) as hits
  from pos a join pos b on a.artist_id = b.artist_id and a.rn < b.rn
  where {edition_match('a.nm', 'b.nm')} group by b.artist_id, b.rn),
steps as (
  select distinct artist_id, cast(0 as bigint) as rn, cast([] as bigint[]) as merged, cast(null as bigint) as master
  from pos
  union all
  select artist_id, rn + 1, case when m is null then merged else list_append(merged, rn + 1) end, m
  from (select s.artist_id, s.rn, s.merged,
               list_filter(coalesce(e.hits, cast([] as bigint[])), lambda x: not list_contains(s.merged, x))[1] as m
        from steps s join pos p on p.artist_id = s.artist_id and p.rn = s.rn + 1
        left join earlier e on e.artist_id = s.artist_id and e.rn = s.rn + 1)),
merges as (
  select p.id as album_id, q.id as master_id
  from steps s join pos p on p.artist_id = s.artist_id and p.rn = s.rn
  join pos q on q.artist_id = s.artist_id and q.rn = s.master)"""


MERGES = f", {merge_views('fx_albums')}"


@check("merge_album_editions", f"{MERGES} select album_id, master_id from merges", recursive=True)
def _(spark, sf_dir):
    return editions.merge_map(lake(spark, sf_dir).albums)


@check("repoint_tracks", f"""{MERGES}
select isrc, title, coalesce(master_id, t.album_id) as album_id
from fx_tracks t left join merges m on m.album_id = t.album_id""", recursive=True)
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return editions.repoint_tracks(lk.tracks, editions.merge_map(lk.albums)).select("isrc", "title", "album_id")


@check("surviving_albums", f"""{MERGES}
select id, name, artist_id, album_type from fx_albums where id not in (select album_id from merges)""", recursive=True)
def _(spark, sf_dir):
    albums = lake(spark, sf_dir).albums
    return editions.surviving_albums(albums, editions.merge_map(albums)).drop("seq")
