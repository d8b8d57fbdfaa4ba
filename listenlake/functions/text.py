"""Text expressions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from listenlake.schemas import EDITION_WORDS, TRACK_URL_PREFIX_LENGTH

# Letters, letter-like numbers and other numbers, but no decimal digits.
LETTER = r"[\p{L}\p{Nl}\p{No}]"
NOT_LETTER = r"[^\p{L}\p{Nl}\p{No}]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


def listening_time(ms: Column) -> Column:
    """Milliseconds as `12h 05m`; hours have no cap, the rest is cut off."""
    ms = F.coalesce(ms, F.lit(0)).cast("long")
    hours = F.call_function("div", ms, F.lit(3600000))
    minutes = F.call_function("div", ms % 3600000, F.lit(60000))
    return F.format_string("%dh %02dm", hours, minutes)


def uri_to_id(uri: Column) -> Column:
    """The part after the last colon."""
    return F.substring_index(uri, ":", -1)


def url_to_id(url: Column) -> Column:
    """The part after the fixed prefix of a track page."""
    return F.substr(url, F.lit(TRACK_URL_PREFIX_LENGTH + 1))


def date_part(ts: Column) -> Column:
    """Characters 1 to 10, with no shift of time zone."""
    return F.substring(ts, 1, 10)


def time_part(ts: Column) -> Column:
    """Characters 12 to 16, with no shift of time zone."""
    return F.substring(ts, 12, 5)


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only, so that accented letters keep their case."""
    return F.translate(text, _UPPER, _LOWER)


def matches(text: Column, query: str) -> Column:
    """Whether `text` holds `query`, folding A-Z; `%` and `_` are wildcards."""
    folded = query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return ascii_lower(text).like(f"%{folded}%")


def has_wildcards(query: str) -> bool:
    return "%" in query or "_" in query


def words(text: Column) -> Column:
    """Runs of letters, in order."""
    return F.regexp_extract_all(text, F.lit(f"({LETTER}+)"), F.lit(1))


def remove_first(text: Column, part: Column) -> Column:
    """`text` without the first `part`; unchanged when it holds none."""
    at = F.position(part, text)
    return F.when(at == 0, text).otherwise(
        F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.char_length(part)))
    )


def all_edition_words(text: Column, vocabulary: Sequence[str] = EDITION_WORDS) -> Column:
    """Whether every word of `text` marks an edition; true when it has no word."""
    known = F.array(*[F.lit(word) for word in vocabulary])
    return F.size(F.array_except(words(text), known)) == 0


def is_edition_of(longer: Column, shorter: Column, vocabulary: Sequence[str] = EDITION_WORDS) -> Column:
    """Whether `longer` is `shorter` plus nothing but edition words (both in lower case)."""
    return longer.contains(shorter) & all_edition_words(remove_first(longer, shorter), vocabulary)


def artist_list(display: Column) -> Column:
    """The names in a display string; wrong only for a name with `, ` in it."""
    return F.when(F.coalesce(display, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(display, ", ", -1)
    )
