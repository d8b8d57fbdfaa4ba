"""Raw exports and track metadata seen through the driver's tables, for Spark and DuckDB.

Every line is a listen on both platforms; FIXTURES.md explains the shapes.
"""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from listenlake.checks.fixtures import table
from listenlake.schemas import HISTORY_A, HISTORY_B, TRACK_METADATA, WORKBOOK_SHEET
from listenlake.session import send_by_value

# The file builders run in Python workers.
send_by_value(__name__)

URL_PREFIX = "https://open.spotify.com/track/"
# One export file holds the listens of this many orders.
ORDERS_PER_FILE = 500


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("int").cast("string"), 2, "0")
    return table(spark, sf_dir, "lineitem").withColumns({
        "day": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "clock": F.concat(two("l_linenumber"), F.lit(":"), two("l_quantity"), F.lit(":00")),
        "k": F.col("l_linenumber") % 4,
        # Distinct wherever the recording is.
        "pos": (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey"),
        "file_no": F.floor(F.col("l_orderkey") / ORDERS_PER_FILE),
    })


def history_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform A rows plus (file, pos, line status)."""
    text = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    platform_id = F.concat(text("sp", "l_partkey"), F.lit("x"), F.col("k").cast("string"))
    return _lines(spark, sf_dir).select(
        F.concat("day", F.lit("T"), "clock", F.lit("Z")).alias("ts"),
        (F.col("l_quantity") * 10000).cast("long").alias("ms_played"),
        text("Song ", "l_partkey").alias("master_metadata_track_name"),
        text("Band ", "l_suppkey").alias("master_metadata_album_artist_name"),
        text("Album ", "l_partkey").alias("master_metadata_album_album_name"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("spotify:track:"), platform_id))
        .alias("spotify_track_uri"),
        F.when(F.col("l_discount") == 0, text("Episode ", "l_orderkey")).alias("episode_name"),
        text("", "file_no").alias("file"),
        "pos",
        F.col("l_linestatus").alias("part"),
        "file_no",
    )


def history_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform B rows plus (file, pos, line status)."""
    text = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    return _lines(spark, sf_dir).select(
        text("Band & Co ", "l_suppkey").alias("Artist"),
        text("Album ", "l_partkey").alias("Album Title"),
        text("Song ", "l_partkey").alias("Song Title"),
        F.when(F.col("l_linenumber") != 7, text("", "l_partkey")).alias("ISRC"),
        F.concat("day", F.lit(" "), "clock").alias("Date"),
        (F.col("l_quantity") * 10).alias("Listening Time"),
        text("", "file_no").alias("file"),
        "pos",
        F.col("l_linestatus").alias("part"),
        "file_no",
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track object per platform id; four ids share a recording code."""
    grouped = _lines(spark, sf_dir).groupBy("l_partkey", "k").agg(
        F.max("l_quantity").cast("long").alias("n"),
        F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"),
    )
    pk, k = F.col("l_partkey").cast("string"), F.col("k").cast("string")
    number = F.floor(F.col("l_partkey") / 8)
    band = (number % 25).cast("string")
    platform_id = F.concat(F.lit("sp"), pk, F.lit("x"), k)
    edition = F.when(F.col("k") == 0, "").when(F.col("k") == 1, " (Deluxe Edition)") \
        .when(F.col("k") == 2, " Live").otherwise(" Remastered")
    kind = (F.col("l_partkey") + F.col("k")) % 4
    person = lambda label, c: F.struct(
        F.concat(F.lit(label[0]), c.cast("string")).alias("id"),
        F.concat(F.lit(f"{label} "), c.cast("string")).alias("name"),
    )
    main = person("Band", band)
    return grouped.select(
        platform_id.alias("id"),
        F.concat(F.lit("Song "), pk).alias("name"),
        (F.col("n") * 5000).alias("duration_ms"),
        F.struct(pk.alias("isrc")).alias("external_ids"),
        F.struct(F.concat(F.lit(URL_PREFIX), platform_id).alias("spotify")).alias("external_urls"),
        F.struct(
            F.concat(F.lit("A"), number.cast("string"), F.lit("t"), k).alias("id"),
            F.concat(F.lit("Album "), number.cast("string"), edition).alias("name"),
            F.when(kind == 0, "album").when(kind == 1, "compilation").when(kind == 2, "single")
            .otherwise("ep").alias("album_type"),
            F.col("n").alias("total_tracks"),
        ).alias("album"),
        F.array(main, person("Singer", F.col("low")), person("Singer", F.col("high")), main).alias("artists"),
        (F.col("k") + 1).cast("int").alias("search_rank"),
    ).to(TRACK_METADATA)


# --- Files: bytes as the platforms would export them -------------------------

def _bundle(rows: DataFrame, columns: list[str], build, suffix: str) -> DataFrame:
    """(path, content) with one file per `file_no`; a file is a bounded slice of orders."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["file_no"].iloc[0])
        return pd.DataFrame({"path": [f"/export/{number:06d}{suffix}"], "content": [build(group[columns], number)]})

    return rows.groupBy("file_no").applyInPandas(pack, "path string, content binary")


def workbook_bytes(rows: pd.DataFrame, number: int) -> bytes:
    """A small workbook: a cover sheet and the history sheet, strings inline."""
    def cells(letter: str, values: list) -> list[str]:
        return [
            f'<c r="{letter}{i}"/>' if v is None or v != v
            else f'<c r="{letter}{i}" t="inlineStr"><is><t>{escape(v) if "&" in v or "<" in v or ">" in v else v}</t></is></c>'
            if isinstance(v, str) else f'<c r="{letter}{i}"><v>{v}</v></c>'
            for i, v in enumerate(values, start=1)
        ]

    columns = [cells(letter, [name, *rows[name].tolist()]) for letter, name in zip("ABCDEFGHIJ", rows.columns)]
    body = "".join(f'<row r="{i}">{"".join(line)}</row>' for i, line in enumerate(zip(*columns), start=1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    relation = "http://schemas.openxmlformats.org/package/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} {link}><sheets>'
                      f'<sheet name="00_cover" sheetId="1" r:id="rId1"/>'
                      f'<sheet name="{WORKBOOK_SHEET}" sheetId="2" r:id="rId2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{relation}">'
                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                      '<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return buffer.getvalue()


def history_json(rows: pd.DataFrame) -> str:
    return json.dumps(json.loads(rows.to_json(orient="records")))


def archive_bytes(rows: pd.DataFrame, number: int) -> bytes:
    """An archive with the history in a folder, and files an import must leave alone."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"data/Streaming_History_Audio_{number}.json", history_json(rows))
        archive.writestr(f"data/._Streaming_History_Audio_{number}.json", "junk")
        archive.writestr(f"data/Streaming_History_Video_{number}.json", "[]")
        archive.writestr("data/ReadMe.pdf", "junk")
    return buffer.getvalue()


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(history_b(spark, sf_dir), HISTORY_B.fieldNames(), workbook_bytes, ".xlsx")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(history_a(spark, sf_dir), HISTORY_A.fieldNames(), archive_bytes, ".zip")


def history_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): one JSON array per export file."""
    record = F.struct(*HISTORY_A.fieldNames())
    return history_a(spark, sf_dir).groupBy("file_no").agg(
        F.to_json(F.sort_array(F.collect_list(record))).alias("value")
    ).select("value")


def write_history_files(arrays: DataFrame, path: str) -> None:
    """One file per array, compressed: as plain text the exports would be many times the tables they are made of."""
    arrays.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


# --- The same rows as DuckDB text --------------------------------------------

SQL = f"""
, fx_lines as (
  select *, strftime(l_shipdate, '%Y-%m-%d') as day,
         lpad(cast(l_linenumber as varchar), 2, '0') || ':' ||
         lpad(cast(cast(l_quantity as int) as varchar), 2, '0') || ':00' as clock,
         (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey as pos,
         l_linenumber % 4 as k, l_orderkey // {ORDERS_PER_FILE} as file_no
  from lineitem),
raw_a as (
  select day || 'T' || clock || 'Z' as ts, cast(l_quantity * 10000 as bigint) as ms_played,
         'Song ' || l_partkey as master_metadata_track_name,
         'Band ' || l_suppkey as master_metadata_album_artist_name,
         'Album ' || l_partkey as master_metadata_album_album_name,
         case when l_linenumber <> 7 then 'spotify:track:sp' || l_partkey || 'x' || k end as spotify_track_uri,
         case when l_discount = 0 then 'Episode ' || l_orderkey end as episode_name,
         cast(file_no as varchar) as file, pos, l_linestatus as part
  from fx_lines),
raw_b as (
  select 'Band & Co ' || l_suppkey as "Artist", 'Album ' || l_partkey as "Album Title",
         'Song ' || l_partkey as "Song Title",
         case when l_linenumber <> 7 then cast(l_partkey as varchar) end as "ISRC",
         day || ' ' || clock as "Date", l_quantity * 10 as "Listening Time",
         cast(file_no as varchar) as file, pos, l_linestatus as part
  from fx_lines),
norm_a as (
  select split_part(spotify_track_uri, ':', -1) as spotify_id, ms_played,
         master_metadata_album_artist_name as artist, master_metadata_track_name as title,
         master_metadata_album_album_name as album, substr(ts, 1, 10) as date, substr(ts, 12, 5) as time,
         file, pos, part
  from raw_a where episode_name is null and ms_played >= 30000),
norm_b as (
  select "ISRC" as isrc, cast("Listening Time" * 1000 as bigint) as ms_played, "Artist" as artist,
         "Song Title" as title, "Album Title" as album, substr("Date", 1, 10) as date,
         substr("Date", 12, 5) as time, file, pos, part
  from raw_b where "Listening Time" * 1000 > 30000),
fx_groups as (
  select l_partkey as pk, k, cast(max(l_quantity) as bigint) as n, min(l_suppkey) as low, max(l_suppkey) as high
  from fx_lines group by all),
meta as (
  select cast(pk as varchar) as isrc, 'sp' || pk || 'x' || k as spotify_id, 'Song ' || pk as title,
         n * 5000 as duration_ms, 'A' || (pk // 8) || 't' || k as album_id,
         'Album ' || (pk // 8) || case k when 0 then '' when 1 then ' (Deluxe Edition)' when 2 then ' Live'
                                         else ' Remastered' end as album_name,
         case (pk + k) % 4 when 0 then 'album' when 1 then 'compilation' when 2 then 'single'
                           else 'ep' end as album_type,
         case (pk + k) % 4 when 0 then 3 when 1 then 2 when 2 then 1 else 0 end as score,
         n as total_tracks, 'B' || ((pk // 8) % 25) as artist_id, 'Band ' || ((pk // 8) % 25) as artist_name,
         'S' || low as low_id, 'S' || high as high_id, low, high, cast(k + 1 as int) as search_rank
  from fx_groups)
"""
