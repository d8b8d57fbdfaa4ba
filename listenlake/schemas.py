"""Table schemas and the fixed values results depend on."""

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# These decide results, so they are stated as plain text.

# A play counts from this many milliseconds on.
MIN_LISTEN_MS = 30000

# Names given to the two platforms in plays.source.
SOURCE_A = "Spotify"
SOURCE_B = "Deezer"

# Release types, best first; any other type scores 0.
RELEASE_SCORES = {"album": 3, "compilation": 2, "single": 1}

# Words that mark another edition of the same album.
EDITION_WORDS = (
    "expansion", "deluxe", "bonus", "extended", "edition", "édition", "version",
    "remastered", "remaster", "long", "bed",
    "epilogue", "boost", "réédition", "anniversary", "track",
    "tracks", "pt", "part", "vol", "volume",
)
# The older vocabulary has two more words.
EDITION_WORDS_V3 = EDITION_WORDS + ("taylors", "taylor")

# Input files.
HISTORY_FILE_GLOB = "Streaming_History_Audio_*.json"
HISTORY_FILE_MARK = "Streaming_History_Audio"
HIDDEN_FILE_PREFIX = "._"
WORKBOOK_SHEET = "10_listeningHistory"

# Track pages share this many characters before the id starts.
TRACK_URL_PREFIX_LENGTH = 31

# --- Stored tables ----------------------------------------------------------
# `seq` is the order of arrival.  Anything that sorts will do: a number, or a
# struct of (batch, file, position).

ARRIVAL = T.StructType([
    T.StructField("batch", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("item", T.LongType()),
])

ARTISTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("seq", ARRIVAL),
])
ALBUMS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("artist_id", T.StringType()),
    T.StructField("album_type", T.StringType()),
    T.StructField("seq", ARRIVAL),
])
TRACKS = T.StructType([
    T.StructField("isrc", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("artist_id", T.StringType()),
    T.StructField("album_id", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("spotify_id", T.StringType()),
])
TRACK_FEATURES = T.StructType([
    T.StructField("track_isrc", T.StringType()),
    T.StructField("artist_id", T.StringType()),
])
PLAYS = T.StructType([
    T.StructField("library", T.StringType()),
    T.StructField("track_isrc", T.StringType()),
    T.StructField("played_at_date", T.DateType()),
    T.StructField("played_at_time", T.StringType()),
    T.StructField("ms_played", T.LongType()),
    T.StructField("source", T.StringType()),
])
TRACK_ALIASES = T.StructType([
    T.StructField("platform_id", T.StringType()),
    T.StructField("isrc", T.StringType()),
])
CATALOG_TABLES = {
    "artists": ARTISTS,
    "albums": ALBUMS,
    "tracks": TRACKS,
    "track_features": TRACK_FEATURES,
    "track_aliases": TRACK_ALIASES,
}

# --- Raw inputs -------------------------------------------------------------

HISTORY_A = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("ms_played", T.LongType()),
    T.StructField("master_metadata_track_name", T.StringType()),
    T.StructField("master_metadata_album_artist_name", T.StringType()),
    T.StructField("master_metadata_album_album_name", T.StringType()),
    T.StructField("spotify_track_uri", T.StringType()),
    T.StructField("episode_name", T.StringType()),
])
HISTORY_B = T.StructType([
    T.StructField("Artist", T.StringType()),
    T.StructField("Album Title", T.StringType()),
    T.StructField("Song Title", T.StringType()),
    T.StructField("ISRC", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Listening Time", T.DoubleType()),
])
TRACK_METADATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("external_ids", T.StructType([T.StructField("isrc", T.StringType())])),
    T.StructField("external_urls", T.StructType([T.StructField("spotify", T.StringType())])),
    T.StructField("album", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("album_type", T.StringType()),
        T.StructField("total_tracks", T.LongType()),
    ])),
    T.StructField("artists", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
    ]))),
    T.StructField("search_rank", T.IntegerType()),
])
