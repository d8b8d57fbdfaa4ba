"""Single operators against DuckDB: projections, filters, joins, aggregates, sets, scalars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from listenlake.checks import raw
from listenlake.checks.fixtures import heard, lake, table
from listenlake.checks.registry import check
from listenlake.checks.report_checks import CREDITS, END, START, fmt, like
from listenlake.functions import media, text
from listenlake.operators import credits, editions, filters, releases
from listenlake.operators.rollup import count_entities, per_track
from listenlake.plans import imports, search
from listenlake.session import tasks_for
from listenlake.sources import history

PLAY_TEXT = "track_isrc, strftime(played_at_date, '%Y-%m-%d') as played_at_date, ms_played, source, library"


def _play_text(plays):
    return plays.select(
        "track_isrc", F.col("played_at_date").cast("string").alias("played_at_date"), "ms_played", "source",
        "library",
    )


# --- Projections and filters --------------------------------------------------

@check("normalize_columns", f"""{raw.SQL}
select master_metadata_album_artist_name as artist, master_metadata_album_album_name as album,
       master_metadata_track_name as title, spotify_track_uri as url from raw_a""")
def _(spark, sf_dir):
    return raw.history_a(spark, sf_dir).withColumnsRenamed({
        "master_metadata_album_artist_name": "artist", "master_metadata_album_album_name": "album",
        "master_metadata_track_name": "title", "spotify_track_uri": "url",
    }).select("artist", "album", "title", "url")


@check("split_timestamp", f"{raw.SQL} select ts, substr(ts, 1, 10) as date, substr(ts, 12, 5) as time from raw_a")
def _(spark, sf_dir):
    ts = F.col("ts")
    return raw.history_a(spark, sf_dir).select(
        "ts", text.date_part(ts).alias("date"), text.time_part(ts).alias("time")
    )


@check("min_listen_filter", """
select 'a' as platform, track_isrc, ms_played from fx_heard where ms_played >= 30000 union all
select 'b', track_isrc, ms_played from fx_heard where ms_played > 30000""")
def _(spark, sf_dir):
    listens = heard(spark, sf_dir).select("track_isrc", "ms_played")
    return filters.long_enough(listens, strict=False).withColumn("platform", F.lit("a")).unionByName(
        filters.long_enough(listens, strict=True).withColumn("platform", F.lit("b"))
    )


@check("exclude_episodes", f"{raw.SQL} select ts, ms_played, spotify_track_uri from raw_a where episode_name is null")
def _(spark, sf_dir):
    return filters.without_episodes(raw.history_a(spark, sf_dir)).select("ts", "ms_played", "spotify_track_uri")


@check("project_history", f"{raw.SQL} select spotify_id, ms_played, artist, title, album, date, time from norm_a")
def _(spark, sf_dir):
    return history.normalize_a(raw.history_a(spark, sf_dir)).select(
        "spotify_id", "ms_played", "artist", "title", "album", "date", "time"
    )


@check("project_history_b", f"{raw.SQL} select isrc, ms_played, artist, title, album, date, time from norm_b")
def _(spark, sf_dir):
    return history.normalize_b(raw.history_b(spark, sf_dir)).select(
        "isrc", "ms_played", "artist", "title", "album", "date", "time"
    )


@check("drop_unkeyed", f"{raw.SQL} select spotify_id, ms_played from norm_a where spotify_id is not null")
def _(spark, sf_dir):
    rows = history.normalize_a(raw.history_a(spark, sf_dir))
    return filters.drop_unkeyed(rows, "spotify_id").select("spotify_id", "ms_played")


@check("plays_in_range", f"""
select {PLAY_TEXT} from fx_plays where played_at_date between date '{START}' and date '{END}'""")
def _(spark, sf_dir):
    return _play_text(filters.in_range(lake(spark, sf_dir).plays, START, END))


@check("plays_in_preset", f"""
select 'this_year' as preset, {PLAY_TEXT} from fx_plays where year(played_at_date) = 1999 union all
select 'last_year', {PLAY_TEXT} from fx_plays where year(played_at_date) = 1998 union all
select 'all', {PLAY_TEXT} from fx_plays""")
def _(spark, sf_dir):
    plays, today = lake(spark, sf_dir).plays, dt.date(1999, 5, 17)
    return history.blend(*[
        _play_text(filters.in_range(plays, *filters.preset_range(preset, today))).withColumn("preset", F.lit(preset))
        for preset in ("this_year", "last_year", "all")
    ])


@check("name_contains", f"""
select 'plain' as pattern, id, name from fx_albums where {like('name', 'LIVE')} union all
select 'any', id, name from fx_albums where {like('name', 'brand%edition')} union all
select 'one', id, name from fx_albums where {like('name', '#_2')}""")
def _(spark, sf_dir):
    albums = lake(spark, sf_dir).albums.select("id", "name")
    return history.blend(*[
        albums.filter(text.matches(F.col("name"), query)).withColumn("pattern", F.lit(label))
        for label, query in (("plain", "LIVE"), ("any", "brand%edition"), ("one", "#_2"))
    ])


@check("tag_source", f"{raw.SQL} select spotify_id, ms_played, 'Spotify' as source from norm_a")
def _(spark, sf_dir):
    return imports.tag_source(
        history.normalize_a(raw.history_a(spark, sf_dir)).select("spotify_id", "ms_played"), "Spotify"
    )


# --- Joins --------------------------------------------------------------------

@check("join_plays_tracks", f"""
select {PLAY_TEXT}, title, album_id from fx_plays join fx_tracks on isrc = track_isrc""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    tracks = lk.tracks.select(F.col("isrc").alias("track_isrc"), "title", "album_id")
    joined = lk.plays.join(tracks, "track_isrc")
    return joined.withColumn("played_at_date", F.col("played_at_date").cast("string")).drop("played_at_time")


@check("join_track_artist", """
select t.isrc, t.title, a.name as artist from fx_tracks t join fx_artists a on a.id = t.artist_id""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    artists = lk.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist"))
    return lk.tracks.join(artists, "artist_id").select("isrc", "title", "artist")


@check("join_track_album_artist", """
select t.isrc, t.title, al.name as album, a.name as album_artist
from fx_tracks t join fx_albums al on al.id = t.album_id join fx_artists a on a.id = al.artist_id""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    albums = lk.albums.select(F.col("id").alias("album_id"), F.col("name").alias("album"), "artist_id")
    artists = lk.artists.select(F.col("id").alias("artist_id"), F.col("name").alias("album_artist"))
    return (
        lk.tracks.drop("artist_id").join(albums, "album_id").join(artists, "artist_id")
        .select("isrc", "title", "album", "album_artist")
    )


@check("join_plays_all_artists", f"""{CREDITS}
select library, artist_id, count(*) as plays, cast(sum(ms_played) as bigint) as total_ms
from fx_plays join credited using (track_isrc) group by library, artist_id""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    numbers = credits.number_artists(credits.all_artists(lk))
    summed = credits.per_library_artist(lk, per_track(lk.plays, ["library"]), numbers)
    return summed.join(numbers, "artist_no").select("library", "artist_id", F.col("play_count").alias("plays"), "total_ms")


@check("track_artist_display", f"{CREDITS} select isrc, artist from fx_tracks left join shown using (isrc)")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    return credits.with_display_names(lk, lk.tracks.select("isrc", "artist_id")).select("isrc", "artist")


@check("left_join_unplayed", """
select isrc, title, count(p.track_isrc) as play_count, cast(coalesce(sum(p.ms_played), 0) as bigint) as total_ms
from fx_tracks left join fx_plays p on p.track_isrc = isrc group by isrc, title""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    rolled = per_track(lk.plays).withColumnRenamed("track_isrc", "isrc")
    return lk.tracks.join(rolled, "isrc", "left").select(
        "isrc", "title", F.coalesce("play_count", F.lit(0)).alias("play_count"),
        F.coalesce("total_ms", F.lit(0)).alias("total_ms"),
    )


@check("semi_feature_match", f"""
select isrc, title from fx_tracks where isrc in (
  select f.track_isrc from fx_track_features f join fx_artists a on a.id = f.artist_id
  where {like('a.name', '0000002')}) or title = 'red widget'""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    hits = search.feature_matches(lk, "0000002").withColumn("hit", F.lit(True))
    return lk.tracks.join(hits, "isrc", "left").filter(
        F.col("hit").isNotNull() | (F.col("title") == "red widget")
    ).select("isrc", "title")


@check("unresolved_ids", f"""{raw.SQL}
select distinct spotify_id from norm_a
where spotify_id is not null and spotify_id not in (select spotify_id || 'x1' from fx_tracks)""")
def _(spark, sf_dir):
    stored = lake(spark, sf_dir).tracks.withColumn("spotify_id", F.concat("spotify_id", F.lit("x1")))
    rows = history.normalize_a(raw.history_a(spark, sf_dir))
    return imports.unresolved_ids(rows, stored).select("spotify_id")


@check("valid_plays", f"""{raw.SQL}
select isrc as track_isrc, date as played_at_date, time as played_at_time, ms_played, 'Deezer' as source
from norm_b where isrc in (select isrc from fx_tracks t join fx_albums al on al.id = t.album_id
                           where al.album_type = 'album')""")
def _(spark, sf_dir):
    known = releases.catalog_album_types(lake(spark, sf_dir)).filter(F.col("album_type") == "album")
    plays = imports.valid_plays(history.normalize_b(raw.history_b(spark, sf_dir)), known)
    return plays.withColumn("played_at_date", F.col("played_at_date").cast("string")).drop("library")


@check("resolve_play_isrc", f"""{raw.SQL}
select m.isrc as track_isrc, date as played_at_date, time as played_at_time, ms_played, 'Spotify' as source
from norm_a left join (select * from meta where score > 0) m using (spotify_id) where spotify_id is not null""")
def _(spark, sf_dir):
    found = releases.flatten_metadata(raw.metadata(spark, sf_dir)).filter(
        media.release_score(F.col("album_type")) > 0
    )
    aliases = found.select(F.col("spotify_id").alias("platform_id"), "isrc")
    plays = imports.resolve_plays(history.normalize_a(raw.history_a(spark, sf_dir)), aliases)
    return plays.withColumn("played_at_date", F.col("played_at_date").cast("string")).drop("library")


@check("catalog_album_type", """
select t.isrc, al.album_type from fx_tracks t join fx_albums al on al.id = t.album_id""")
def _(spark, sf_dir):
    return releases.catalog_album_types(lake(spark, sf_dir))


@check("isrcs_to_resolve", f"""{raw.SQL}
select distinct n.isrc from norm_b n
left join (select t.isrc, al.album_type from fx_tracks t join fx_albums al on al.id = t.album_id) c using (isrc)
where n.isrc is not null and c.album_type is distinct from 'album'""")
def _(spark, sf_dir):
    rows = history.normalize_b(raw.history_b(spark, sf_dir))
    return imports.isrcs_to_resolve(rows, releases.catalog_album_types(lake(spark, sf_dir))).select("isrc")


VOCABULARY = ", ".join(f"'{w}'" for w in editions.EDITION_WORDS)
WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')"


def first_removed(longer: str, shorter: str) -> str:
    at = f"strpos({longer}, {shorter})"
    return (f"(case when {at} = 0 then {longer} else substr({longer}, 1, {at} - 1) || "
            f"substr({longer}, {at} + length({shorter})) end)")


def edition_match(longer: str, shorter: str) -> str:
    words = WORDS.format(first_removed(longer, shorter))
    return (f"contains({longer}, {shorter}) and "
            f"len(list_filter({words}, lambda w: not list_contains([{VOCABULARY}], w))) = 0")


DISTINCT_NAMES = """
, names as (
  select artist_id, lower(name) as nm, arg_min(id, (-length(name), seq, id)) as id,
         min((-length(name), seq, id)) as ord
  from fx_albums group by artist_id, lower(name))"""


@check("album_pair_candidates", f"""{DISTINCT_NAMES}
select a.artist_id, a.id as longer_id, b.id as shorter_id
from names a join names b on a.artist_id = b.artist_id and a.ord < b.ord and a.nm <> b.nm
where {edition_match('a.nm', 'b.nm')}""")
def _(spark, sf_dir):
    return editions.edition_pairs(lake(spark, sf_dir).albums).select("artist_id", "longer_id", "shorter_id")


# --- Aggregates ---------------------------------------------------------------

@check("sum_listening_ms", "select library, cast(sum(ms_played) as bigint) as total_ms from fx_plays group by library")
def _(spark, sf_dir):
    return lake(spark, sf_dir).plays.groupBy("library").agg(F.sum("ms_played").alias("total_ms"))


@check("count_resolved_plays", """
select source, count(track_isrc) as play_count, count(*) as listens from fx_plays group by source""")
def _(spark, sf_dir):
    return lake(spark, sf_dir).plays.groupBy("source").agg(
        F.count("track_isrc").alias("play_count"), F.count("*").alias("listens")
    )


@check("distinct_entities", """
select library, count(distinct track_isrc) as tracks, count(distinct t.artist_id) as artists,
       count(distinct t.album_id) as albums
from fx_plays left join fx_tracks t on t.isrc = track_isrc group by library""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    tracks = lk.tracks.select(F.col("isrc").alias("track_isrc"), "artist_id", "album_id", "isrc")
    tasks = tasks_for(spark, lk.plays.count())
    joined = per_track(lk.plays, ["library"]).repartition(tasks, "track_isrc").join(tracks, "track_isrc", "left")
    return count_entities(joined, "library", {"tracks": "isrc", "artists": "artist_id", "albums": "album_id"}, tasks)


@check("first_listen", """
select t.isrc, coalesce(strftime(min(p.played_at_date), '%Y-%m-%d'), 'N/A') as first_listen
from fx_tracks t left join fx_plays p on p.track_isrc = t.isrc group by t.isrc""")
def _(spark, sf_dir):
    lk = lake(spark, sf_dir)
    first = per_track(lk.plays).select(F.col("track_isrc").alias("isrc"), F.col("first_listen").alias("day"))
    return lk.tracks.select("isrc").join(first, "isrc", "left").select(
        "isrc", F.coalesce(F.col("day").cast("string"), F.lit("N/A")).alias("first_listen")
    )


@check("concat_artist_names", f"{CREDITS} select isrc, artist from shown")
def _(spark, sf_dir):
    return credits.display_names(lake(spark, sf_dir))


# --- Orders and sets ----------------------------------------------------------

@check("albums_by_name_length", """
select artist_id, id, name, length(name) as name_length from fx_albums order by artist_id, name_length desc, seq""")
def _(spark, sf_dir):
    return lake(spark, sf_dir).albums.withColumn("name_length", F.length("name").cast("long")).orderBy(
        "artist_id", F.desc("name_length"), "seq"
    ).select("artist_id", "id", "name", "name_length")


@check("track_all_artists", f"{CREDITS} select track_isrc, artist_id from credited")
def _(spark, sf_dir):
    return credits.all_artists(lake(spark, sf_dir))


@check("track_artist_names", f"{CREDITS} select isrc, ord, artist_id, name from credit_names")
def _(spark, sf_dir):
    return credits.credit_names(lake(spark, sf_dir))


@check("blend_files", f"""{raw.SQL}
select part, null as episode_name, ts, ms_played from raw_a where part = 'O' union all
select part, episode_name, ts, ms_played from raw_a where part = 'F'""")
def _(spark, sf_dir):
    rows = raw.history_a(spark, sf_dir).select("part", "episode_name", "ts", "ms_played")
    return history.blend(rows.filter("part = 'F'"), rows.filter("part = 'O'").drop("episode_name"))


@check("blend_sources", f"""{raw.SQL}
select spotify_id, null as isrc, ms_played, title, date, 'Spotify' as source from norm_a union all
select null, isrc, ms_played, title, date, 'Deezer' from norm_b""")
def _(spark, sf_dir):
    a = imports.tag_source(history.normalize_a(raw.history_a(spark, sf_dir)), "Spotify")
    b = imports.tag_source(history.normalize_b(raw.history_b(spark, sf_dir)), "Deezer")
    return history.blend(a, b).select("spotify_id", "isrc", "ms_played", "title", "date", "source")


@check("distinct_keys", f"""{raw.SQL}
select spotify_id, min(struct_pack(f := file, p := pos)).p as first_pos from norm_a
where spotify_id is not null group by spotify_id""")
def _(spark, sf_dir):
    rows = history.normalize_a(raw.history_a(spark, sf_dir))
    return imports.first_seen(rows, "spotify_id").select("spotify_id", F.col("seq.pos").alias("first_pos"))


# --- Scalars ------------------------------------------------------------------

@check("format_listening_time", f"""
select track_isrc, {fmt('total_ms')} as listening_time from (
  select coalesce(track_isrc, '') as track_isrc, cast(sum(ms_played) as bigint) as total_ms
  from fx_plays group by all)""")
def _(spark, sf_dir):
    return per_track(lake(spark, sf_dir).plays).select(
        "track_isrc", text.listening_time(F.col("total_ms")).alias("listening_time")
    )


@check("uri_to_id", f"""{raw.SQL}
select spotify_track_uri as uri, split_part(spotify_track_uri, ':', -1) as id from raw_a""")
def _(spark, sf_dir):
    uri = F.col("spotify_track_uri")
    return raw.history_a(spark, sf_dir).select(uri.alias("uri"), text.uri_to_id(uri).alias("id"))


@check("url_to_id", f"{raw.SQL} select spotify_id as id, '{raw.URL_PREFIX}' || spotify_id as url from meta")
def _(spark, sf_dir):
    url = F.col("external_urls.spotify")
    return raw.metadata(spark, sf_dir).select(url.alias("url"), text.url_to_id(url).alias("id"))


@check("seconds_to_ms", f"""{raw.SQL}
select "Listening Time" as seconds, cast("Listening Time" * 1000 as bigint) as ms from raw_b""")
def _(spark, sf_dir):
    seconds = F.col("Listening Time")
    return raw.history_b(spark, sf_dir).select(seconds.alias("seconds"), media.seconds_to_ms(seconds).alias("ms"))


@check("release_score", f"{raw.SQL} select spotify_id, album_type, score from meta")
def _(spark, sf_dir):
    kind = F.col("album.album_type")
    return raw.metadata(spark, sf_dir).select(
        F.col("id").alias("spotify_id"), kind.alias("album_type"), media.release_score(kind).alias("score")
    )


@check("flatten_metadata", f"""{raw.SQL}
select isrc, spotify_id, title, duration_ms, album_id, album_name, album_type, total_tracks, artist_id from meta""")
def _(spark, sf_dir):
    return releases.flatten_metadata(raw.metadata(spark, sf_dir)).select(
        "isrc", "spotify_id", "title", "duration_ms", "album_id", "album_name", "album_type", "total_tracks",
        "artist_id",
    )


@check("explode_features", f"""{raw.SQL}
select isrc as track_isrc, unnest([low_id, high_id, artist_id]) as artist_id from meta""")
def _(spark, sf_dir):
    return releases.explode_features(releases.flatten_metadata(raw.metadata(spark, sf_dir)))


@check("album_name_lower", "select id, lower(name) as name_lower from fx_albums")
def _(spark, sf_dir):
    return lake(spark, sf_dir).albums.select("id", F.lower("name").alias("name_lower"))


# Each album beside its brand or segment, which most names start with.
ALBUM_STEMS = """
, stems as (
  select id, lower(name) as nm, lower(coalesce(p.stem, c_mktsegment)) as stem
  from fx_albums left join (select distinct p_brand || '|' || p_type as id, p_brand as stem from part) p using (id)
  left join customer on 'C' || c_custkey = id)"""


def _stems(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(
        F.concat_ws("|", "p_brand", "p_type").alias("id"), F.col("p_brand").alias("stem")
    ).distinct()
    segments = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("stem")
    )
    return lake(spark, sf_dir).albums.join(brands.unionByName(segments), "id").select(
        "id", F.lower("name").alias("nm"), F.lower("stem").alias("stem")
    )


@check("name_difference", f"{ALBUM_STEMS} select id, {first_removed('nm', 'stem')} as difference from stems")
def _(spark, sf_dir):
    return _stems(spark, sf_dir).select("id", text.remove_first(F.col("nm"), F.col("stem")).alias("difference"))


@check("edition_words", f"{ALBUM_STEMS} select id, array_to_string({WORDS.format('nm')}, '|') as words from stems")
def _(spark, sf_dir):
    return _stems(spark, sf_dir).select("id", F.array_join(text.words(F.col("nm")), "|").alias("words"))


@check("is_edition_variant", f"{ALBUM_STEMS} select id, {edition_match('nm', 'stem')} as is_variant from stems")
def _(spark, sf_dir):
    return _stems(spark, sf_dir).select("id", text.is_edition_of(F.col("nm"), F.col("stem")).alias("is_variant"))


@check("artist_list", f"""{CREDITS}
, parts as (select isrc, string_split(artist, ', ') as parts from shown)
select isrc, unnest(range(len(parts))) as pos, unnest(parts) as name from parts""")
def _(spark, sf_dir):
    shown = credits.display_names(lake(spark, sf_dir))
    return shown.select("isrc", F.posexplode(text.artist_list(F.col("artist"))).alias("pos", "name")).withColumn(
        "pos", F.col("pos").cast("long")
    )
