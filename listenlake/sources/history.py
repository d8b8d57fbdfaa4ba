"""Readers for the two platforms' exports and their normalized form.

Normalized plays have (library, platform key, ms_played, artist, title, album,
date, time, arrival); `arrival` is (file, pos), the order of import.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from listenlake.functions.media import seconds_to_ms
from listenlake.functions.text import date_part, time_part, uri_to_id
from listenlake.operators.filters import long_enough, without_episodes
from listenlake.schemas import (
    HIDDEN_FILE_PREFIX, HISTORY_A, HISTORY_B, HISTORY_FILE_GLOB, HISTORY_FILE_MARK, WORKBOOK_SHEET,
)
from listenlake.session import send_by_value

# The workbook and archive readers run in Python workers.
send_by_value(__name__)

FILE_TEXT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("value", T.StringType()),
])
SHEET_ROWS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("pos", T.LongType()),
    *HISTORY_B.fields,
])
_BATCH_ROWS = 10_000


# --- Platform A: JSON -------------------------------------------------------

def parse_history(files: DataFrame) -> DataFrame:
    """Rows of (file, pos, history columns) from whole files of one JSON array each.

    A file that is not such an array is an error, not a silent gap.
    """
    records = F.from_json("value", T.ArrayType(HISTORY_A), {"mode": "FAILFAST"})
    return files.select("file", F.posexplode(records).alias("pos", "record")).select(
        "file", F.col("pos").cast("long").alias("pos"), "record.*"
    )


def history_files(df: DataFrame) -> DataFrame:
    """(file, value) of a whole-text read, batch or stream."""
    return df.select(F.col("_metadata.file_path").alias("file"), "value")


def read_history_json(spark: SparkSession, path: str | list[str], name_glob: str = HISTORY_FILE_GLOB,
                      recursive: bool = False) -> DataFrame:
    """All history files of a folder; no files give no rows.

    Exports are many files of a few MB, so the file is the unit of work.
    """
    files = spark.read.text(
        path, wholetext=True, pathGlobFilter=name_glob, recursiveFileLookup=recursive
    )
    return parse_history(history_files(files))


def normalize_a(history: DataFrame, library: Column | str = "") -> DataFrame:
    """Songs of at least 30 s, no episodes, with the platform id cut from the link."""
    renamed = history.withColumnsRenamed({
        "master_metadata_album_artist_name": "artist",
        "master_metadata_album_album_name": "album",
        "master_metadata_track_name": "title",
        "spotify_track_uri": "url",
    })
    songs = long_enough(without_episodes(renamed), strict=False)
    return songs.select(
        _library(library).alias("library"),
        uri_to_id(F.col("url")).alias("spotify_id"),
        "ms_played", "artist", "title", "album",
        date_part(F.col("ts")).alias("date"), time_part(F.col("ts")).alias("time"),
        F.struct("file", "pos").alias("arrival"),
    )


# --- Platform B: workbook ---------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROWS, _ROW, _CELL, _TEXT = f"{_MAIN}sheetData", f"{_MAIN}row", f"{_MAIN}c", f"{_MAIN}t"
#: Bytes parsed at a time: the rows of a piece stay in the processor cache.
_PIECE = 1 << 14
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_part(book: zipfile.ZipFile, sheet: str) -> str:
    """Archive member that holds the named sheet."""
    listing = ElementTree.fromstring(book.read("xl/workbook.xml"))
    link = next(s.get(_LINK) for s in listing.iter(f"{_MAIN}sheet") if s.get("name") == sheet)
    targets = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(t.get("Target") for t in targets if t.get("Id") == link)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    table = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    # Text of the item and of its runs; phonetic runs repeat it as a reading.
    return ["".join(t.text or "" for x in item if x.tag != f"{_MAIN}rPh" for t in x.iter(f"{_MAIN}t"))
            for item in table.iter(f"{_MAIN}si")]


def _column(cell: ElementTree.Element, place: int) -> str:
    """Letters of a cell's column: from its reference, or by its place where it has none."""
    if cell.get("r"):
        return cell.get("r").rstrip("0123456789")
    letters, place = "", place + 1
    while place:
        place, rest = divmod(place - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _cell(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        # As nearly every cell is: one item that holds one plain text.
        if len(cell) == 1 and len(cell[0]) == 1 and cell[0][0].tag == _TEXT:
            return cell[0][0].text or None
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
    value = cell.findtext(f"{_MAIN}v")
    if kind == "s" and value is not None:
        return shared[int(value)] or None
    return value or None


def _stream_rows(part) -> Iterator[ElementTree.Element]:
    """Row elements of a sheet, a piece of the file at a time: Python sees whole rows only, not the end of every element."""
    builder = ElementTree.TreeBuilder()
    parser = ElementTree.XMLParser(target=builder)
    rows = None
    while piece := part.read(_PIECE):
        parser.feed(piece)
        if rows is None:
            # The tree as far as it is built.
            root = builder.close()
            rows = root.find(_ROWS) if root is not None else None
        if rows is not None:
            # The last row may go on in the next piece.
            whole = rows[:-1]
            yield from (row for row in whole if row.tag == _ROW)
            del rows[:len(whole)]
    parser.close()
    yield from (row for row in rows if row.tag == _ROW) if rows is not None else ()


def _sheet_rows(content: bytes, sheet: str) -> Iterator[dict[str, str | None]]:
    """Rows of one sheet as {column letters: text}, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        with book.open(_sheet_part(book, sheet)) as part:
            for row in _stream_rows(part):
                yield {_column(c, k): _cell(c, shared) for k, c in enumerate(row.iter(_CELL))}


def unpack_workbooks(files: DataFrame, sheet: str = WORKBOOK_SHEET) -> DataFrame:
    """Sheet rows of (path, content) files; the first row names the columns."""
    wanted = HISTORY_B.fieldNames()

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=SHEET_ROWS.fieldNames())
            out["Listening Time"] = pd.to_numeric(out["Listening Time"])
            return out

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, letters = [], {}
                for pos, row in enumerate(_sheet_rows(content, sheet)):
                    if pos == 0:
                        letters = {name: letter for letter, name in row.items()}
                        continue
                    rows.append((path, pos - 1, *[row.get(letters[name]) for name in wanted]))
                    if len(rows) == _BATCH_ROWS:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    return files.select("path", "content").mapInPandas(unpack, SHEET_ROWS)


def read_history_workbook(spark: SparkSession, path: str | list[str], name_glob: str = "*.[xX][lL][sS][xX]") -> DataFrame:
    """The history sheet of every workbook in a folder."""
    return unpack_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", name_glob).load(path))


def normalize_b(history: DataFrame, library: Column | str = "") -> DataFrame:
    """Songs of more than 30 s, times in ms, rounded after the filter has seen the seconds."""
    renamed = history.withColumnsRenamed({
        "Artist": "artist", "Album Title": "album", "Song Title": "title", "ISRC": "isrc",
    })
    long_ = long_enough(renamed, strict=True, listened=F.col("Listening Time") * 1000)
    return long_.withColumn("ms_played", seconds_to_ms(F.col("Listening Time"))).select(
        _library(library).alias("library"),
        "isrc", "ms_played", "artist", "title", "album",
        date_part(F.col("Date")).alias("date"), time_part(F.col("Date")).alias("time"),
        F.struct("file", "pos").alias("arrival"),
    )


# --- Picking and unpacking input files --------------------------------------

def is_history_json(name: Column) -> Column:
    return (
        ~name.startswith(HIDDEN_FILE_PREFIX)
        & F.lower(name).endswith(".json")
        & name.contains(HISTORY_FILE_MARK)
    )


def stage_input_files(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of (path, name, length), the files an import takes, one per name and length.

    `by` names further columns, such as the listener, whose files are kept apart.
    """
    name = F.col("name")
    workbook = ~name.startswith(HIDDEN_FILE_PREFIX) & F.lower(name).endswith(".xlsx")
    taken = files.filter(workbook | is_history_json(name))
    return taken.groupBy(*by, "name", "length").agg(F.min("path").alias("path")).select(*by, "path", "name", "length")


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, name, length) of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length"
    )


def unpack_archives(files: DataFrame) -> DataFrame:
    """(file, value) of the history files inside zip archives of (path, content)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.infolist():
                        name = member.filename.rsplit("/", 1)[-1]
                        if not member.is_dir() and HISTORY_FILE_MARK in name:
                            value = archive.read(member).decode("utf-8")
                            yield pd.DataFrame([(f"{path}!{name}", value)], columns=FILE_TEXT.fieldNames())

    inside = files.select("path", "content").mapInPandas(unpack, FILE_TEXT)
    return inside.filter(is_history_json(F.substring_index("file", "!", -1)))


def read_history_archive(spark: SparkSession, path: str | list[str], name_glob: str = "*.zip") -> DataFrame:
    """History rows from the zip archives of a folder."""
    return parse_history(unpack_archives(
        spark.read.format("binaryFile").option("pathGlobFilter", name_glob).load(path)
    ))


def blend(*histories: DataFrame) -> DataFrame:
    """One frame of several; a column one of them lacks is null there."""
    blended = histories[0]
    for other in histories[1:]:
        blended = blended.unionByName(other, allowMissingColumns=True)
    return blended


def _library(library: Column | str) -> Column:
    return library if isinstance(library, Column) else F.lit(library)
