"""Merging the editions of one album.

Within an artist, albums are taken longest name first, then by arrival.  An
album joins the first album before it that has not itself been merged, holds
its name, and differs by nothing but edition words.

No artist's albums are ever gathered in one task and no pairs of them are
formed.  Each name instead lists the few shorter names it could stand for (cut
edition words off its front and back), and those are looked up by equality.
The list depends on the one name alone, so an artist with a third of all
albums costs as much per album as any other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.functions.text import NOT_LETTER, all_edition_words
from listenlake.schemas import EDITION_WORDS
from listenlake.session import cut_lineage


def _loose_front(text: Column, vocabulary: Sequence[str]) -> Column:
    """How much of the front is edition words, whole or begun: any cut within it may be one."""
    whole = "|".join(map(re.escape, vocabulary))
    begun = sorted({w[:n] for w in vocabulary for n in range(1, len(w) + 1)}, key=len, reverse=True)
    pattern = f"^(?:(?:{whole})?{NOT_LETTER})*+(?:{'|'.join(map(re.escape, begun))})?"
    return F.length(F.regexp_extract(text, pattern, 0))


def shorter_names(name: Column, vocabulary: Sequence[str] = EDITION_WORDS) -> Column:
    """Every other name that `name` (in lower case) would be an edition of."""
    size = F.length(name)
    starts = F.sequence(F.lit(0), _loose_front(name, vocabulary))
    back = _loose_front(F.reverse(name), [w[::-1] for w in vocabulary])
    ends = F.transform(F.sequence(F.lit(0), back), lambda n: size - n)
    spans = F.flatten(F.transform(starts, lambda s: F.transform(
        F.filter(ends, lambda e: e >= s), lambda e: F.struct(s.alias("s"), e.alias("e"))
    )))

    def part(span: Column) -> Column:
        return F.substring(name, span["s"] + 1, span["e"] - span["s"])

    def fits(span: Column) -> Column:
        rest = F.concat(F.substring(name, F.lit(1), span["s"]), F.substring(name, span["e"] + 1, size))
        return (
            (span["e"] - span["s"] < size)
            & (F.position(part(span), name) == span["s"] + 1)
            & all_edition_words(rest, vocabulary)
        )

    return F.array_distinct(F.transform(F.filter(spans, fits), part))


def _named(albums: DataFrame) -> DataFrame:
    order = F.struct((-F.length("name")).alias("longest"), "seq", "id")
    return albums.dropna(subset=["name"]).select(
        "artist_id", "id", F.lower("name").alias("nm"), order.alias("ord")
    )


def _distinct_names(albums: DataFrame) -> DataFrame:
    """(artist_id, nm, ord): albums of an artist with one name share their fate, so the first stands for all."""
    return _named(albums).groupBy("artist_id", "nm").agg(F.min("ord").alias("ord"))


def edition_pairs(albums: DataFrame, vocabulary: Sequence[str] = EDITION_WORDS) -> DataFrame:
    """(artist_id, longer_id, longer_ord, shorter_id): name pairs that may merge."""
    names = _distinct_names(albums)
    longer = names.select(
        F.col("artist_id").alias("longer_artist"), F.col("ord").alias("longer_ord"),
        F.explode(shorter_names(F.col("nm"), vocabulary)).alias("candidate"),
    )
    same_artist = F.col("longer_artist").eqNullSafe(F.col("artist_id"))
    pairs = longer.join(names, same_artist & (F.col("candidate") == F.col("nm")))
    return pairs.filter(F.col("longer_ord") < F.col("ord")).select(
        "artist_id", F.col("longer_ord.id").alias("longer_id"), "longer_ord",
        F.col("ord.id").alias("shorter_id"),
    )


def _unmerged(pairs: DataFrame) -> DataFrame:
    """(longer_id) of names that are not merged into a longer one.

    A name is merged once a longer unmerged name is known, and stays once all
    longer ones are merged.  Names on no pair's short side stay from the start.
    Every round settles at least one more level of nesting; in practice one
    round settles all.
    """
    tops = pairs.select(F.col("longer_id").alias("id")).distinct().join(
        pairs.select(F.col("shorter_id").alias("id")), "id", "left_anti"
    ).withColumn("merged", F.lit(False))
    known = tops
    while True:
        seen = pairs.join(known.withColumnRenamed("id", "longer_id"), "longer_id", "left").groupBy(
            F.col("shorter_id").alias("id")
        ).agg(
            F.bool_or(F.coalesce(~F.col("merged"), F.lit(False))).alias("merged"),
            F.bool_and(F.coalesce("merged", F.lit(False))).alias("stays"),
        )
        seen = cut_lineage(seen)
        known = tops.unionByName(seen.filter("merged OR stays").select("id", "merged"))
        if seen.filter("NOT merged AND NOT stays").isEmpty():
            return known.filter("NOT merged").select(F.col("id").alias("longer_id"))


def merge_map(albums: DataFrame, vocabulary: Sequence[str] = EDITION_WORDS) -> DataFrame:
    """(album_id, master_id) for every album that is merged; a master is never merged itself."""
    pairs = cut_lineage(edition_pairs(albums, vocabulary))
    masters = pairs.join(_unmerged(pairs), "longer_id", "left_semi").groupBy("shorter_id").agg(
        F.min_by("longer_id", "longer_ord").alias("longer_id")
    )
    first = _distinct_names(albums).select(
        F.col("artist_id").alias("name_artist"), F.col("nm").alias("name"), F.col("ord.id").alias("first_id")
    )
    same_name = F.col("artist_id").eqNullSafe(F.col("name_artist")) & (F.col("nm") == F.col("name"))
    return (
        _named(albums).join(first, same_name)
        .join(masters, F.col("first_id") == F.col("shorter_id"), "left")
        .select(F.col("id").alias("album_id"), F.coalesce("longer_id", "first_id").alias("master_id"))
        .filter(F.col("album_id") != F.col("master_id"))
    )


def repoint_tracks(tracks: DataFrame, merges: DataFrame) -> DataFrame:
    """Move the tracks of merged albums to their master."""
    return tracks.join(merges, "album_id", "left").withColumn(
        "album_id", F.coalesce("master_id", "album_id")
    ).select(*tracks.columns)


def surviving_albums(albums: DataFrame, merges: DataFrame) -> DataFrame:
    """Albums that were not merged into another."""
    return albums.join(merges.select(F.col("album_id").alias("id")), "id", "left_anti").select(*albums.columns)
