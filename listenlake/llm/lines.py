"""Line dedup: lines whose key is found in many documents go from every document.

A text is split at \\n (null or empty: one empty line).  A line's key is the line with
blanks (`[\\x20\\x09-\\x0D]`) stripped at both ends and A-Z lower-cased; a key of at least
one code point that is found in at least `least_docs` documents loses all its lines.

Method: every line becomes (key hash, document, position), 128 bits of two xxhash64
seeds, no text.  These rows are range-partitioned on (hash, document) and sorted by
position within it, so a key held by a third of all documents is spread over many
tasks by document, and each task streams the first occurrence of a key in a document
once; per key only partial counts of documents move.  Keys at or over the threshold
are joined back to the line rows (broadcast after a measured size, else by shuffle with
adaptive skew splitting), and what each document loses comes back as a compressed keep
bitmap: the runs (first position, length) of dropped lines; kept text is derived from
that and the text where it is wanted, so text never moves for the count.

Rows: a document is its doc_id (null is one document); rows that share an id count as one
document for the threshold, and each row keeps its own lines by its own text.  Ties do not
arise: a key is counted, not ranked.  Very long texts are split into as many rows as lines;
a text of a million equal lines is one (key, document) row after the first task.  An empty
table gives no rows.  Extra columns of `docs` stay as they are; the result's own columns
replace columns of the same names.  Two different keys share a 128-bit hash with a chance
of about n^2 / 2^129 for n distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.text import ascii_lower
from listenlake.session import cut_lineage

#: A key found in at least so many documents loses its lines.
LEAST_DOCS = 10
#: A key needs at least so many code points.
LEAST_CHARS = 1
#: Blanks stripped from both ends of a line for its key.
BLANK = r"[\x20\x09-\x0D]"
#: The frequent keys are broadcast when at most so many bytes (16 a key).
BROADCAST_BYTES = 64 << 20
#: Own column names, chosen so as not to meet a caller's.
_ID, _TH, _POS, _H1, _H2 = "_ld_doc", "_ld_text_hash", "_ld_pos", "_ld_h1", "_ld_h2"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.regexp_replace(line, rf"^{BLANK}+|{BLANK}+\z", ""))


def text_lines(text: Column) -> Column:
    """Lines of a text split at \\n, empty ones kept; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line: document, text hash (tells rows of one id apart), position, key hash and whether the key counts."""
    lines = docs.select(
        F.col("doc_id").alias(_ID), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(_TH),
        F.posexplode(text_lines(F.col("text"))).alias(_POS, "line"),
    )
    key = line_key(F.col("line"))
    return lines.select(
        _ID, _TH, _POS, F.xxhash64(key).alias(_H1), F.xxhash64(F.lit(LEAST_DOCS), key).alias(_H2),
        (F.length(key) >= LEAST_CHARS).alias("counts"),
    )


def frequent_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2) of keys found in at least `least_docs` documents.

    Range partitions of (hash, document) with the lines of a (key, document) sorted by position:
    the first occurrence of each (key, document) is kept, then documents are counted per key with
    partial counts per task, so a hot key moves one row per task.
    """
    counted = lines.filter("counts").select(_H1, _H2, _ID, _POS)
    counted = counted.repartitionByRange(_H1, _H2, _ID).sortWithinPartitions(_H1, _H2, _ID, _POS)
    first = counted.groupBy(_H1, _H2, _ID).agg(F.min(_POS).alias("first"))
    return first.groupBy(_H1, _H2).agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= least_docs).select(_H1, _H2)


def _unused(name: str, taken: list[str]) -> str:
    """`name`, lengthened until no column of `taken` has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _runs(positions: Column) -> Column:
    """Sorted positions as runs (start, length)."""
    n = F.size(positions)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.try_element_at(positions, i - 1) + 1 != F.try_element_at(positions, i)))
    return F.when(n == 0, F.array().cast("array<struct<start:int,length:int>>")).otherwise(F.transform(starts, lambda s, k: F.struct(
        F.try_element_at(positions, s).cast("int").alias("start"),
        (F.coalesce(F.try_element_at(starts, k + 2), n + 1) - s).cast("int").alias("length"),
    )))


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per distinct (doc_id, text) with lines to drop: doc_id, the text's hash and `dropped` runs (start, length) of line positions.

    Rows without a dropped line are not listed: their bitmap keeps everything.
    """
    lines = cut_lineage(line_rows(docs))
    frequent = cut_lineage(frequent_keys(lines, least_docs))
    if frequent.count() * 16 <= BROADCAST_BYTES:
        frequent = F.broadcast(frequent)
    dropped = lines.join(frequent, [_H1, _H2]).select(_ID, _TH, _POS)
    # Rows repeated under one id and text give their positions once.
    bitmaps = dropped.groupBy(_ID, _TH).agg(F.array_sort(F.collect_set(_POS)).alias("positions"))
    return bitmaps.select(F.col(_ID).alias("doc_id"), F.col(_TH).alias("text_hash"), _runs(F.col("positions")).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with n_lines, n_dropped and `kept_text`: the lines outside the dropped runs, joined by \\n."""
    own = ["n_lines", "n_dropped", "kept_text"]
    kept_columns = [c for c in docs.columns if c not in own]
    key, th, other_th, marked = (_unused(name, kept_columns) for name in (_ID, _TH, "_ld_th2", "_ld_runs"))
    base = docs.select(*kept_columns).withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    marks = bitmaps.select(F.col("doc_id").alias(key), F.col("text_hash").alias(other_th), F.col("dropped").alias(marked))
    joined = base.join(marks, base["doc_id"].eqNullSafe(marks[key]) & (base[th] == marks[other_th]), "left")
    runs = F.coalesce(F.col(marked), F.array().cast("array<struct<start:int,length:int>>"))
    lines = text_lines(F.col("text"))
    # Positions outside the runs, by a set difference: linear in the lines of a text.
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.element_at(lines, i + 1))
    n_dropped = F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["length"])
    return joined.select(
        *[base[c] for c in kept_columns],
        F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"),
    )


def drop_frequent_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text (see the module)."""
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), least_docs))
