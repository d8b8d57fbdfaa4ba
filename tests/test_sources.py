import datetime as dt
import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from listenlake.checks import raw
from listenlake.checks.raw import workbook_bytes
from listenlake.operators import filters
from listenlake.plans import reports
from listenlake.schemas import HISTORY_B, PLAYS, WORKBOOK_SHEET
from listenlake.sources import history
from listenlake.session import checkpoint_root
from listenlake.sources.store import LakeStore, VersionTaken, write_records


def listen(ts="2020-01-02T03:04:05Z", ms=60000, uri="spotify:track:x", episode=None, title="Song"):
    return {"ts": ts, "ms_played": ms, "master_metadata_track_name": title,
            "master_metadata_album_artist_name": "Band", "master_metadata_album_album_name": "Album",
            "spotify_track_uri": uri, "episode_name": episode, "platform": "ignored"}


def write_history(folder, name, listens):
    (folder / name).write_text(json.dumps(listens, indent=2), encoding="utf-8")


def test_history_json_keeps_file_and_row_order(spark, tmp_path):
    write_history(tmp_path, "Streaming_History_Audio_2.json", [listen(title="c")])
    write_history(tmp_path, "Streaming_History_Audio_1.json", [listen(title="a"), listen(title="b")])
    write_history(tmp_path, "Streaming_History_Video_1.json", [listen(title="no")])
    write_history(tmp_path, "._Streaming_History_Audio_1.json", [listen(title="no")])
    got = history.read_history_json(spark, str(tmp_path)).orderBy("file", "pos")
    assert [r[0] for r in rows(got, "master_metadata_track_name")] == ["a", "b", "c"]


def test_a_folder_without_history_gives_no_rows(spark, tmp_path):
    (tmp_path / "other.txt").write_text("x")
    got = history.normalize_a(history.read_history_json(spark, str(tmp_path)))
    assert got.count() == 0 and "spotify_id" in got.columns


def test_a_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "Streaming_History_Audio_1.json").write_text("[{")
    with pytest.raises(Exception, match="MALFORMED"):
        history.read_history_json(spark, str(tmp_path)).collect()


def test_platform_a_rules(spark, tmp_path):
    write_history(tmp_path, "Streaming_History_Audio_1.json", [
        listen(ms=29999, title="short"), listen(ms=30000, title="just"), listen(ms=30001, title="more"),
        listen(episode="talk", title="podcast"), listen(uri=None, title="no link"),
    ])
    got = history.normalize_a(history.read_history_json(spark, str(tmp_path)), "me")
    assert sorted(rows(got, "title", "spotify_id")) == [("just", "x"), ("more", "x"), ("no link", None)]
    assert set(rows(got, "library", "date", "time")) == {("me", "2020-01-02", "03:04")}


def sheet(**changed):
    row = {"Artist": "Band & Co", "Album Title": "Album", "Song Title": "Song", "ISRC": "I1",
           "Date": "2020-01-02 03:04:05", "Listening Time": 60}
    return {**row, **changed}


def test_workbook_from_disk(spark, tmp_path):
    frame = pd.DataFrame([sheet(**{"Listening Time": s, "Song Title": f"{s}"}) for s in (29, 30, 31)]
                         + [sheet(ISRC=None, **{"Song Title": "no code"})], columns=HISTORY_B.fieldNames())
    (tmp_path / "data.xlsx").write_bytes(workbook_bytes(frame, 0))
    raw = history.read_history_workbook(spark, str(tmp_path))
    assert raw.count() == 4
    assert sorted(rows(history.normalize_b(raw), "title", "isrc", "ms_played", "artist", "time")) == [
        ("31", "I1", 31000, "Band & Co", "03:04"), ("no code", None, 60000, "Band & Co", "03:04"),
    ]


def test_workbook_with_shared_strings_and_gaps(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = HISTORY_B.fieldNames()
    # Columns come in another order than the schema's, one cell is missing.
    order = [5, 3, 0, 1, 2, 4]
    strings = [names[i] for i in order] + ["I9", "Ar", "Ti", "2021-05-06 07:08:09"]
    table = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings)
    head = "".join(f'<c r="{"ABCDEF"[j]}1" t="s"><v>{j}</v></c>' for j in range(6))
    body = ('<c r="A2"><v>45</v></c><c r="B2" t="s"><v>6</v></c><c r="C2" t="s"><v>7</v></c>'
            '<c r="E2" t="s"><v>8</v></c><c r="F2" t="s"><v>9</v></c>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{link}"><sheets>'
                      '<sheet name="10_listeningHistory" sheetId="1" r:id="r7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/'
                      'package/2006/relationships"><Relationship Id="r7" Target="/xl/worksheets/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{table}</sst>")
        book.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData><row r='1'>{head}</row>"
                      f"<row r='2'>{body}</row></sheetData></worksheet>")
    assert rows(history.read_history_workbook(spark, str(tmp_path)), *[f"`{n}`" for n in names]) == \
        [("Ar", None, "Ti", "I9", "2021-05-06 07:08:09", 45.0)]


def test_archive_from_disk(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as archive:
        archive.writestr("a/", "")
        archive.writestr("a/Streaming_History_Audio_1.json", json.dumps([listen(title="in"), listen(title="too")]))
        archive.writestr("a/Streaming_History_Audio_2.JSON", json.dumps([listen(title="upper")]))
        archive.writestr("a/._Streaming_History_Audio_1.json", "junk")
        archive.writestr("a/Streaming_History_Audio_1.pdf", "junk")
        archive.writestr("a/Other.json", "junk")
    got = history.read_history_archive(spark, str(tmp_path))
    assert sorted(r[0] for r in rows(got, "master_metadata_track_name")) == ["in", "too", "upper"]


def test_staging_keeps_one_of_each_name_and_length(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        write_history(tmp_path / folder, "Streaming_History_Audio_1.json", [])
        (tmp_path / folder / "book.XLSX").write_text("x" if folder == "a" else "yy")
        (tmp_path / folder / "._book.xlsx").write_text("x")
        (tmp_path / folder / "notes.txt").write_text("x")
    files = history.list_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(rows(history.stage_input_files(files), "name", "length")) == [
        ("Streaming_History_Audio_1.json", 2), ("book.XLSX", 1), ("book.XLSX", 2),
    ]


def test_listeners_files_are_staged_apart(spark):
    files = spark.createDataFrame([("p1", "Streaming_History_Audio_1.json", 5, "ann"), ("p2", "Streaming_History_Audio_1.json", 5, "bob"),
                                   ("p3", "Streaming_History_Audio_1.json", 5, "bob")], "path string, name string, length long, library string")
    assert sorted(rows(history.stage_input_files(files, ["library"]), "library", "path")) == [("ann", "p1"), ("bob", "p2")]


def test_a_repeated_batch_loses_years_it_no_longer_has(spark, tmp_path):
    store = LakeStore(spark, str(tmp_path), buckets=2).create()
    store.append_plays(play_rows(spark, ("x", "t", "2020-01-01", 1), ("x", "t", "2021-01-01", 2)), "one")
    store.append_plays(play_rows(spark, ("x", "t", "2021-01-01", 2)), "one")
    assert rows(store.read().plays, "ms_played") == [(2,)]
    store.append_plays(play_rows(spark, ("x", "t", "2022-01-01", 3)), "two", commit=False)
    assert store.read().plays.count() == 1  # not listed, not seen


def test_two_imports_of_one_version_clash(spark, tmp_path):
    store = LakeStore(spark, str(tmp_path), buckets=2).create()
    seen = store.version()
    store.write_catalog(store.empty(), "one", based_on=seen)
    with pytest.raises(VersionTaken):
        store.write_catalog(store.empty(), "two", based_on=seen)
    assert store.finished("one") and not store.finished("two") and store.version() == 1
    store._claim(2)
    with pytest.raises(VersionTaken):
        store.write_catalog(store.empty(), "three")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_root(Session())


def test_seconds_are_filtered_before_they_are_rounded(spark):
    rows_b = [("f", 0, "a", "t", "al", "I1", 30.0005, "2020-01-01 10:00:00"), ("f", 1, "a", "t", "al", "I1", 30.0, "2020-01-01 10:00:00"),
              ("f", 2, "a", "t", "al", "I1", 31.001, "2020-01-01 10:00:00")]
    raw = spark.createDataFrame(rows_b, ["file", "pos", "Artist", "Song Title", "Album Title", "ISRC", "Listening Time", "Date"])
    assert sorted(rows(history.normalize_b(raw), "ms_played")) in ([(30000,), (31001,)], [(30001,), (31001,)])


def test_presets():
    today = dt.date(2024, 2, 29)
    assert filters.preset_range("this_year", today) == (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    assert filters.preset_range("last_year", today) == (dt.date(2023, 1, 1), dt.date(2023, 12, 31))
    assert filters.preset_range("all", today) == (None, None)
    with pytest.raises(ValueError):
        filters.preset_range("custom", today)


def play_rows(spark, *listens):
    return spark.createDataFrame(
        [(library, isrc, day and dt.date.fromisoformat(day), "10:00", ms, "Spotify") for library, isrc, day, ms in listens],
        PLAYS,
    )


def test_store_appends_by_batch_and_prunes(spark, tmp_path):
    store = LakeStore(spark, str(tmp_path), buckets=8).create()
    assert store.read().plays.count() == 0 and store.version() == 0
    first = play_rows(spark, ("x", "t", "2020-01-01", 1), ("x", "t", "2020-01-01", 1), ("y", "t", "2021-01-01", 2))
    store.append_plays(first, "one")
    store.append_plays(first, "one")
    assert store.read().plays.count() == 3
    store.append_plays(first, "two", dedupe=True)
    assert store.read().plays.count() == 5
    # A lake keeps the bucket count it was made with.
    again = LakeStore(spark, str(tmp_path), buckets=3)
    assert again.buckets == 8
    mine = again.read("x").plays
    assert rows(mine.select("library").distinct()) == [("x",)] and mine.count() == 3
    scan = filters.in_range(mine, "2020-01-01", "2020-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "library_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "played_at_date" in scan.split("PushedFilters: [")[1].split("]")[0]


def test_plays_without_a_date_are_kept(spark, tmp_path):
    store = LakeStore(spark, str(tmp_path), buckets=2).create()
    store.append_plays(play_rows(spark, ("x", "t", None, 5), ("x", None, "2020-01-01", 6)), "one")
    plays = store.read().plays
    assert plays.agg(F.sum("ms_played")).first()[0] == 11
    assert filters.in_range(plays, end="2030-01-01").agg(F.sum("ms_played")).first()[0] == 6


def test_catalog_versions(spark, tmp_path, small):
    store = LakeStore(spark, str(tmp_path)).create()
    arrival = F.struct(F.lit(0).cast("long").alias("batch"), F.lit("f").alias("file"), F.col("seq").alias("pos"),
                       F.lit(0).cast("long").alias("item"))
    tracks = small.tracks.selectExpr("*", "cast(1 as bigint) as duration_ms", "isrc as spotify_id")
    lake = small.with_tables(artists=small.artists.withColumn("seq", arrival), tracks=tracks,
                             albums=small.albums.withColumn("seq", arrival))
    assert store.write_catalog(lake, "one") == 1
    assert store.read().artists.count() == 5 and store.finished("one") and not store.finished("two")
    assert store.create().version() == 1


def test_records_round_trip(spark, tmp_path, small):
    report = reports.top_tracks(small)
    write_records(report, str(tmp_path / "out"))
    assert sorted(rows(spark.read.schema(report.schema).json(str(tmp_path / "out")))) == sorted(rows(report))


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 20])
def test_sheet_rows_are_whole_wherever_a_piece_of_the_file_ends(piece, monkeypatch):
    monkeypatch.setattr(history, "_PIECE", piece)
    frame = pd.DataFrame({"Artist": ["A & <B>", None, "C"], "Song Title": ["é", "x" * 300, ""], "Listening Time": [1.5, 2.0, 3.0]})
    got = list(history._sheet_rows(raw.workbook_bytes(frame, 1), WORKBOOK_SHEET))
    assert got == [{"A": "Artist", "B": "Song Title", "C": "Listening Time"}, {"A": "A & <B>", "B": "é", "C": "1.5"},
                   {"A": None, "B": "x" * 300, "C": "2.0"}, {"A": "C", "B": None, "C": "3.0"}]
    assert list(history._stream_rows(io.BytesIO(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"/>'))) == []


def test_history_files_of_the_check_are_compressed_and_read_whole(spark, tmp_path):
    records = [{"ts": f"2020-01-{i:02d}T00:00:00Z", "ms_played": i} for i in range(1, 29)]
    arrays = spark.createDataFrame([(json.dumps(records),), (json.dumps(records[:3]),)], "value string")
    raw.write_history_files(arrays, str(tmp_path / "out"))
    names = [f.name for f in (tmp_path / "out").glob("part-*")]
    assert len(names) >= 2 and all(n.endswith(".gz") for n in names)
    got = history.read_history_json(spark, str(tmp_path / "out"), name_glob="part-*").select("ts", "ms_played").collect()
    assert sorted(tuple(r) for r in got) == sorted((r["ts"], r["ms_played"]) for r in records + records[:3])
