"""Reports, search and details against DuckDB."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from listenlake.checks.fixtures import lake
from listenlake.checks.registry import check
from listenlake.functions.text import listening_time
from listenlake.operators import pages, sums
from listenlake.operators.filters import drop_unkeyed
from listenlake.operators.rollup import per_track
from listenlake.operators.topk import medal, top_k, with_rank
from listenlake.plans import details, reports, search

START, END = "1996-03-01", "2000-06-30"
TODAY = dt.date(1999, 5, 17)
ARTIST, ARTIST_NAME = "S7", "Supplier#000000007"
ALBUM, ALBUM_NAME = "Brand#2|ECONOMY", "Brand#2"

TIME = """cast(coalesce(sum(ms_played), 0) as bigint)"""


def fmt(ms: str) -> str:
    return (f"cast({ms} // 3600000 as varchar) || 'h ' || "
            f"lpad(cast(({ms} % 3600000) // 60000 as varchar), 2, '0') || 'm'")


# Views the statements share.
CREDITS = """
, credited as (
  select isrc as track_isrc, artist_id from fx_tracks
  union
  select track_isrc, artist_id from fx_track_features),
credit_names as (
  select t.isrc, 0 as ord, a.id as artist_id, a.name from fx_tracks t join fx_artists a on a.id = t.artist_id
  union all
  select f.track_isrc, 1, a.id, a.name from fx_track_features f join fx_artists a on a.id = f.artist_id),
shown as (
  select isrc, string_agg(name, ', ' order by ord, artist_id) as artist from credit_names group by isrc)
"""

TOTALS = "cast(coalesce(sum(p.ms_played), 0) as bigint) as total_ms, count(p.track_isrc) as play_count"
RANGE = f"p.played_at_date between date '{START}' and date '{END}'"


def tracks_sql(where: str = "true", by: str = "total_ms", limit: int = 10) -> str:
    return f"""{CREDITS}
, totals as (
  select p.track_isrc as isrc, {TOTALS} from fx_plays p where {where} group by p.track_isrc)
select t.title, s.artist, o.total_ms, o.play_count, {fmt('o.total_ms')} as listening_time
from totals o join fx_tracks t using (isrc) left join shown s using (isrc)
order by o.{by} desc, isrc limit {limit}"""


def artists_sql(where: str = "true", by: str = "total_ms", limit: int = 10) -> str:
    return f"""{CREDITS}
, totals as (
  select a.id, any_value(a.name) as name, {TOTALS}
  from fx_plays p join credited c using (track_isrc) join fx_artists a on a.id = c.artist_id
  where {where} group by a.id)
select name, total_ms, play_count, {fmt('total_ms')} as listening_time
from totals order by {by} desc, id limit {limit}"""


def albums_sql(where: str = "true", by: str = "total_ms", limit: int = 10) -> str:
    return f"""
, totals as (
  select al.id, any_value(al.name) as album, any_value(a.name) as artist, {TOTALS}
  from fx_plays p join fx_tracks t on t.isrc = p.track_isrc join fx_albums al on al.id = t.album_id
  join fx_artists a on a.id = al.artist_id
  where {where} group by al.id)
select album, artist, total_ms, play_count, {fmt('total_ms')} as listening_time
from totals order by {by} desc, id limit {limit}"""


def stats_sql(where: str = "true") -> str:
    return f"""
select {fmt(TIME)} as listening_time, count(p.track_isrc) as total_plays,
       count(distinct p.track_isrc) as total_tracks, count(distinct a.id) as total_artists,
       count(distinct t.album_id) as total_albums
from fx_plays p left join fx_tracks t on t.isrc = p.track_isrc left join fx_artists a on a.id = t.artist_id
where {where}"""


@check("general_stats", stats_sql(RANGE))
def _(spark, sf_dir):
    return reports.general_stats(lake(spark, sf_dir), START, END)


@check("general_stats_all_time", stats_sql())
def _(spark, sf_dir):
    return reports.general_stats(lake(spark, sf_dir))


@check("general_stats_per_library", stats_sql().replace("select ", "select p.library, ", 1) + " group by p.library")
def _(spark, sf_dir):
    return reports.general_stats(lake(spark, sf_dir), per_library=True)


@check("top_tracks", tracks_sql(RANGE))
def _(spark, sf_dir):
    return reports.top_tracks(lake(spark, sf_dir), start=START, end=END)


@check("top_tracks_by_plays", tracks_sql(by="play_count"))
def _(spark, sf_dir):
    return reports.top_tracks(lake(spark, sf_dir), param=1)


@check("top_tracks_by_time", tracks_sql())
def _(spark, sf_dir):
    return reports.top_tracks(lake(spark, sf_dir), param=0)


@check("top_tracks_unlimited", tracks_sql(limit=10**9))
def _(spark, sf_dir):
    return reports.top_tracks(lake(spark, sf_dir), limit=-1)


@check("top_tracks_pages", tracks_sql(limit=10**9))
def _(spark, sf_dir):
    # The whole list read page after page by cursors from one stored ranking: equal to the unlimited list.
    keyed = reports.top_tracks_keyed(lake(spark, sf_dir), limit=-1)
    ranking = pages.StoredRanking.store(keyed.select("isrc", "title", "artist", "total_ms", "play_count"), "total_ms", "isrc")
    read = pages.pages(ranking, pages.BLOCK, ["title", "artist", "total_ms", "play_count"])
    return read.orderBy("rank").withColumn("listening_time", listening_time(F.col("total_ms"))).select(
        "title", "artist", "total_ms", "play_count", "listening_time")


@check("top_tracks_from_sums", tracks_sql("p.played_at_date between '1995-03-17' and '2000-10-09'", limit=25))
def _(spark, sf_dir):
    # Edge days, edge months and whole years of stored sums instead of plays.
    lk = lake(spark, sf_dir)
    return reports.top_tracks(lk, limit=25, start="1995-03-17", end="2000-10-09", sums=sums.Sums.build(lk))


@check("top_tracks_of_library", tracks_sql("p.library = 'L7'", limit=25))
def _(spark, sf_dir):
    return reports.top_tracks(lake(spark, sf_dir), limit=25, library="L7")


@check("top_tracks_main_artist", f"""
, totals as (
  select p.track_isrc as isrc, {TOTALS} from fx_plays p group by p.track_isrc)
select t.title, a.name as artist, o.total_ms, o.play_count, {fmt('o.total_ms')} as listening_time
from totals o join fx_tracks t using (isrc) join fx_artists a on a.id = t.artist_id
order by o.total_ms desc, isrc limit 10""")
def _(spark, sf_dir):
    return reports.top_tracks(lake(spark, sf_dir), artist_display="main")


@check("top_tracks_per_library", f"""{CREDITS}
, totals as (
  select p.library, p.track_isrc as isrc, {TOTALS} from fx_plays p group by p.library, p.track_isrc)
select o.library, t.title, s.artist, o.total_ms, o.play_count, {fmt('o.total_ms')} as listening_time
from totals o join fx_tracks t using (isrc) left join shown s using (isrc)
qualify row_number() over (partition by o.library order by o.total_ms desc, isrc) <= 10""")
def _(spark, sf_dir):
    return reports.top_tracks(lake(spark, sf_dir), per_library=True)


@check("top_artists", artists_sql(RANGE))
def _(spark, sf_dir):
    return reports.top_artists(lake(spark, sf_dir), start=START, end=END)


@check("top_artists_by_plays", artists_sql(by="play_count", limit=25))
def _(spark, sf_dir):
    return reports.top_artists(lake(spark, sf_dir), limit=25, param=1)


@check("top_artists_per_library", f"""{CREDITS}
, totals as (
  select p.library, a.id, any_value(a.name) as name, {TOTALS}
  from fx_plays p join credited c using (track_isrc) join fx_artists a on a.id = c.artist_id
  group by p.library, a.id)
select library, name, total_ms, play_count, {fmt('total_ms')} as listening_time from totals
qualify row_number() over (partition by library order by total_ms desc, id) <= 10""")
def _(spark, sf_dir):
    return reports.top_artists(lake(spark, sf_dir), per_library=True)


@check("top_albums", albums_sql(RANGE))
def _(spark, sf_dir):
    return reports.top_albums(lake(spark, sf_dir), start=START, end=END)


@check("top_albums_by_plays", albums_sql(by="play_count", limit=25))
def _(spark, sf_dir):
    return reports.top_albums(lake(spark, sf_dir), limit=25, param=1)


@check("top_albums_per_library", f"""
, totals as (
  select p.library, al.id, any_value(al.name) as album, any_value(a.name) as artist, {TOTALS}
  from fx_plays p join fx_tracks t on t.isrc = p.track_isrc join fx_albums al on al.id = t.album_id
  join fx_artists a on a.id = al.artist_id group by p.library, al.id)
select library, album, artist, total_ms, play_count, {fmt('total_ms')} as listening_time from totals
qualify row_number() over (partition by library order by total_ms desc, id) <= 10""")
def _(spark, sf_dir):
    return reports.top_albums(lake(spark, sf_dir), per_library=True)


@check("top_k", f"""
, totals as (select p.track_isrc, {TOTALS} from fx_plays p where p.track_isrc is not null group by p.track_isrc)
select track_isrc, total_ms, play_count from totals order by play_count desc, track_isrc limit 50""")
def _(spark, sf_dir):
    plays = drop_unkeyed(lake(spark, sf_dir).plays, "track_isrc")
    return top_k(per_track(plays).select("track_isrc", "total_ms", "play_count"), "play_count", ["track_isrc"], 50)


@check("ranked_top_tracks", f"""
, totals as (select p.track_isrc as isrc, {TOTALS} from fx_plays p group by p.track_isrc),
best as (
  select isrc, t.title, o.total_ms, o.play_count from totals o join fx_tracks t using (isrc)
  order by total_ms desc, isrc limit 25),
ranked as (select *, row_number() over (order by total_ms desc, isrc) as rank from best)
select rank, case when rank <= 3 then 'top-' || rank else '' end as medal, isrc, title, total_ms, play_count
from ranked""")
def _(spark, sf_dir):
    ranked = with_rank(reports.top_tracks_keyed(lake(spark, sf_dir), limit=25), "total_ms", ["isrc"], 25)
    return ranked.select(
        F.col("rank").cast("long").alias("rank"), medal(F.col("rank")).alias("medal"),
        "isrc", "title", "total_ms", "play_count",
    )


ARTIST_TRACKS = f"""
totals as (
  select p.track_isrc as isrc, any_value(t.title) as title, any_value(al.name) as album, {TOTALS}
  from fx_plays p join credited c using (track_isrc) join fx_tracks t on t.isrc = p.track_isrc
  join fx_albums al on al.id = t.album_id
  where c.artist_id = '{ARTIST}' and {{where}} group by p.track_isrc)"""


@check("artist_top_tracks", f"""{CREDITS}, {ARTIST_TRACKS.format(where=RANGE)}
select title, album, artist, total_ms, play_count, {fmt('total_ms')} as listening_time
from totals left join shown using (isrc) order by total_ms desc, isrc limit 10""")
def _(spark, sf_dir):
    return reports.artist_top_tracks(lake(spark, sf_dir), ARTIST, start=START, end=END)


@check("artist_top_tracks_asked_artist", f"""{CREDITS}, {ARTIST_TRACKS.format(where="true")}
select title, album, (select name from fx_artists where id = '{ARTIST}') as artist, total_ms, play_count,
       {fmt('total_ms')} as listening_time
from totals order by play_count desc, isrc limit 10""")
def _(spark, sf_dir):
    return reports.artist_top_tracks(lake(spark, sf_dir), ARTIST, param=1, artist_display="asked")


ARTIST_ALBUMS = f"""
totals as (
  select al.id, any_value(al.name) as album, any_value(a.name) as artist, {TOTALS}
  from fx_plays p join credited c using (track_isrc) join fx_tracks t on t.isrc = p.track_isrc
  join fx_albums al on al.id = t.album_id join fx_artists a on a.id = c.artist_id
  where a.id = '{ARTIST}' group by al.id)"""


@check("artist_top_albums", f"""{CREDITS}, {ARTIST_ALBUMS}
select album, artist, total_ms, play_count, {fmt('total_ms')} as listening_time
from totals order by total_ms desc, id limit 10""")
def _(spark, sf_dir):
    return reports.artist_top_albums(lake(spark, sf_dir), ARTIST)


ALBUM_TRACKS = f"""
totals as (
  select p.track_isrc as isrc, any_value(t.title) as title, any_value(al.name) as album, {TOTALS}
  from fx_plays p join fx_tracks t on t.isrc = p.track_isrc join fx_albums al on al.id = t.album_id
  where al.id = '{ALBUM}' group by p.track_isrc)"""


@check("album_tracks", f"""{CREDITS}, {ALBUM_TRACKS}
select title, album, artist, total_ms, play_count, {fmt('total_ms')} as listening_time
from totals left join shown using (isrc) order by total_ms desc, isrc limit 10""")
def _(spark, sf_dir):
    return reports.album_tracks(lake(spark, sf_dir), ALBUM)


DETAIL = f"""select count(p.track_isrc) as total_plays, {TIME} as total_ms, {fmt(TIME)} as listening_time,
       count(distinct p.track_isrc) as unique_tracks,
       coalesce(strftime(min(p.played_at_date), '%Y-%m-%d'), 'N/A') as first_listen"""


@check("artist_stats", f"""{CREDITS}
{DETAIL} from fx_plays p join credited c using (track_isrc) where c.artist_id = '{ARTIST}'""")
def _(spark, sf_dir):
    return reports.artist_stats(lake(spark, sf_dir), ARTIST)


@check("artist_stats_never_played", f"""{CREDITS}
{DETAIL} from fx_plays p join credited c using (track_isrc) where c.artist_id = 'N3'""")
def _(spark, sf_dir):
    return reports.artist_stats(lake(spark, sf_dir), "N3")


@check("album_stats", f"""
{DETAIL} from fx_plays p join fx_tracks t on t.isrc = p.track_isrc where t.album_id = '{ALBUM}'""")
def _(spark, sf_dir):
    return reports.album_stats(lake(spark, sf_dir), ALBUM)


@check("find_artist_id", f"select arg_min(id, (seq, id)) as id from fx_artists where name = '{ARTIST_NAME}'")
def _(spark, sf_dir):
    return details.find_artist_id(lake(spark, sf_dir), ARTIST_NAME)


@check("find_album_id", "select arg_min(id, (seq, id)) as id from fx_albums where name = 'HOUSEHOLD Live'")
def _(spark, sf_dir):
    return details.find_album_id(lake(spark, sf_dir), "HOUSEHOLD Live")


def like(column: str, query: str) -> str:
    return f"lower({column}) like lower('%{query}%')"


def search_tracks_view(query: str, limit: int) -> str:
    return f"""
found_tracks as (
  select t.isrc, any_value(t.title) as name, any_value(s.artist) as artist, {TOTALS}
  from fx_tracks t left join shown s using (isrc) left join fx_albums al on al.id = t.album_id
  left join fx_plays p on p.track_isrc = t.isrc
  where {like('t.title', query)} or {like('s.artist', query)} or {like('al.name', query)}
     or t.isrc in (select f.track_isrc from fx_track_features f join fx_artists a on a.id = f.artist_id
                   where {like('a.name', query)})
  group by t.isrc order by play_count desc, t.isrc limit {limit})"""


def search_artists_view(query: str, limit: int) -> str:
    return f"""
found_artists as (
  select a.id, any_value(a.name) as name, {TOTALS}
  from fx_artists a left join credited c on c.artist_id = a.id left join fx_plays p on p.track_isrc = c.track_isrc
  where {like('a.name', query)} group by a.id order by play_count desc, a.id limit {limit})"""


def search_albums_view(query: str, limit: int) -> str:
    return f"""
found_albums as (
  select al.id, any_value(al.name) as name, any_value(a.name) as artist, {TOTALS}
  from fx_albums al join fx_artists a on a.id = al.artist_id left join fx_tracks t on t.album_id = al.id
  left join fx_plays p on p.track_isrc = t.isrc
  where {like('al.name', query)} or {like('a.name', query)}
  group by al.id order by play_count desc, al.id limit {limit})"""


SHOWN_TRACKS = f"select name, artist, total_ms, play_count, {fmt('total_ms')} as listening_time from found_tracks"


@check("search_tracks", f"{CREDITS}, {search_tracks_view('Household', 40)} {SHOWN_TRACKS}")
def _(spark, sf_dir):
    return search.search_tracks(lake(spark, sf_dir), "Household", limit=40)


@check("search_tracks_across_names", f"{CREDITS}, {search_tracks_view('7, SUPP%00_1', 40)} {SHOWN_TRACKS}")
def _(spark, sf_dir):
    return search.search_tracks(lake(spark, sf_dir), "7, SUPP%00_1", limit=40)


@check("search_artists", f"""{CREDITS}, {search_artists_view('00000001', 40)}
select name, total_ms, play_count, {fmt('total_ms')} as listening_time from found_artists""")
def _(spark, sf_dir):
    return search.search_artists(lake(spark, sf_dir), "00000001", limit=40)


@check("search_albums", f"""{CREDITS}, {search_albums_view('live', 40)}
select name, artist, total_ms, play_count, {fmt('total_ms')} as listening_time from found_albums""")
def _(spark, sf_dir):
    return search.search_albums(lake(spark, sf_dir), "live", limit=40)


def section(label: str, view: str, by: str, key: str, **columns: str) -> str:
    shown = {"name": "name", "artist": "null", "album": "null", "first_listen": "null",
             "unique_tracks": "null", **columns}
    return f"""
select '{label}' as section, cast(row_number() over (order by {by} desc, {key}) as int) as rank,
       {shown['name']} as name, cast({shown['artist']} as varchar) as artist,
       cast({shown['album']} as varchar) as album, total_ms, play_count, {fmt('total_ms')} as listening_time,
       cast({shown['first_listen']} as varchar) as first_listen,
       cast({shown['unique_tracks']} as bigint) as unique_tracks
from {view}"""


@check("search_all", f"""{CREDITS}, {search_tracks_view('live', 10)}, {search_artists_view('live', 10)},
{search_albums_view('live', 10)}
{section('tracks', 'found_tracks', 'play_count', 'isrc', artist='artist')} union all
{section('artists', 'found_artists', 'play_count', 'id')} union all
{section('albums', 'found_albums', 'play_count', 'id', artist='artist')}""")
def _(spark, sf_dir):
    return details.search_all(lake(spark, sf_dir), "live")


STATS_SECTION = """select 'stats' as section, cast(null as int) as rank, {name} as name, {artist} as artist,
       cast(null as varchar) as album, total_ms, total_plays as play_count, listening_time, first_listen,
       unique_tracks from stats where {known} is not null"""


def named(statement: str, table: str, key: str, name: str) -> str:
    """The statement with `key` found by name, as the detail pages do."""
    found = f"(select arg_min(id, (seq, id)) from {table} where name = '{name}')"
    return statement.replace(f"'{key}'", found).replace("{known}", found)


@check("artist_detail", named(f"""{CREDITS}, {ARTIST_TRACKS.format(where="true")},
best_tracks as (select * from totals left join shown using (isrc) order by total_ms desc, isrc limit 10),
{ARTIST_ALBUMS.strip().replace('totals as', 'album_totals as', 1)},
best_albums as (select * from album_totals order by total_ms desc, id limit 10),
stats as ({DETAIL} from fx_plays p join credited c using (track_isrc) where c.artist_id = '{ARTIST}')
{STATS_SECTION.format(name=f"'{ARTIST_NAME}'", artist="cast(null as varchar)", known="{known}")} union all
{section('tracks', 'best_tracks', 'total_ms', 'isrc', name='title', artist='artist', album='album')} union all
{section('albums', 'best_albums', 'total_ms', 'id', name='album', artist='artist', album='album')}""",
                              "fx_artists", ARTIST, ARTIST_NAME))
def _(spark, sf_dir):
    return details.artist_detail(lake(spark, sf_dir), ARTIST_NAME)


@check("album_detail", named(f"""{CREDITS}, {ALBUM_TRACKS},
best_tracks as (select * from totals left join shown using (isrc) order by total_ms desc, isrc limit 50),
stats as ({DETAIL} from fx_plays p join fx_tracks t on t.isrc = p.track_isrc where t.album_id = '{ALBUM}'),
owner as (select a.name from fx_albums al join fx_artists a on a.id = al.artist_id where al.id = '{ALBUM}')
{STATS_SECTION.format(name=f"'{ALBUM_NAME}'", artist="(select name from owner)", known="{known}")} union all
{section('tracks', 'best_tracks', 'total_ms', 'isrc', name='title', artist='artist', album='album')}""",
                             "fx_albums", ALBUM, ALBUM_NAME))
def _(spark, sf_dir):
    return details.album_detail(lake(spark, sf_dir), ALBUM_NAME)


@check("dashboard", f"""{CREDITS}
, in_year as (select * from fx_plays where played_at_date between date '1998-01-01' and date '1998-12-31'),
stats as ({stats_sql().strip().replace('fx_plays', 'in_year')}),
best_tracks as (
  select isrc, any_value(t.title) as title, any_value(s.artist) as artist, {TOTALS}
  from in_year p join fx_tracks t on t.isrc = p.track_isrc left join shown s using (isrc)
  group by isrc order by play_count desc, isrc limit 10),
best_artists as (
  select a.id, any_value(a.name) as name, {TOTALS}
  from in_year p join credited c using (track_isrc) join fx_artists a on a.id = c.artist_id
  group by a.id order by play_count desc, a.id limit 10)
select 'stats' as section, cast(null as int) as rank, unnest(['plays', 'tracks', 'artists', 'albums']) as name,
       cast(null as varchar) as artist, cast(null as varchar) as album, cast(null as bigint) as total_ms,
       unnest([total_plays, total_tracks, total_artists, total_albums]) as play_count, listening_time,
       cast(null as varchar) as first_listen, cast(null as bigint) as unique_tracks from stats union all
{section('tracks', 'best_tracks', 'play_count', 'isrc', name='title', artist='artist')} union all
{section('artists', 'best_artists', 'play_count', 'id')}""")
def _(spark, sf_dir):
    return details.dashboard(lake(spark, sf_dir), "last_year", param=1, today=TODAY)
