"""Benchmark decontamination by winnowed fingerprints.

Windows of the benchmark are WINDOW consecutive words; an item of fewer is one window.
Of every span of WINDOW words, document or item, the smallest K-word hash (leftmost of
equals) is kept, so equal spans keep the same one at the same place: joining the kept
hashes misses no shared window.  Hits are extended by comparing the words around them.

Null text has no words and is hit nowhere; nor is anything if the benchmark is empty.
Rows that share an id are judged each by its own text; items of one text are found
together, and an item id that occurs twice counts once.  Extra columns stay; columns
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.text import ascii_lower, let, small
from listenlake.session import cut_lineage

WINDOW, K = 13, 5
#: Runs of these characters, after lower-casing, separate words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def run_of(words: Column, at: Column, length: int) -> Column:
    return F.concat_ws(" ", F.slice(words, at + 1, length))


def gram_hashes(words: Column, length: int) -> Column:
    """Hash of every run of `length` words, in order; the length is part of it."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: F.xxhash64(
        F.lit(length), *[F.get(words, i + j) for j in range(length)]
    ))


def kept_hashes(words: Column, window: int = WINDOW, k: int = K) -> Column:
    """The smallest hash of each window, in order of the windows; empty for fewer than `window` words."""
    wide = window - k + 1
    return F.when(F.size(words) < window, F.array().cast("array<bigint>")).otherwise(let(gram_hashes(words, k), lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - wide + 1), lambda i: F.array_min(F.slice(h, i, wide))
    )))


def benchmark_index(items: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (print, place, length, words, window) and which texts hold them (window, text_key).

    `print` is the kept hash of a window and `place` the word it begins at; a short item is its own print.
    """
    texts = items.select(item_words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct().withColumn(
        "text_key", F.sha2(F.concat_ws(" ", "words"), 256))
    long_ = texts.filter(F.size("words") >= window).select("text_key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("i"))
    long_ = long_.select("text_key", F.slice("words", F.col("i") + 1, window).alias("words")).withColumn("length", F.lit(window))
    hashed = long_.withColumn("hashes", gram_hashes(F.col("words"), k)).withColumn("print", F.array_min("hashes"))
    hashed = hashed.withColumn("place", (F.array_position("hashes", F.col("print")) - 1).cast("int")).drop("hashes")
    short = None
    for n in range(1, window):
        one = texts.filter(F.size("words") == n).select("text_key", "words", F.lit(n).alias("length")).withColumn(
            "print", gram_hashes(F.col("words"), n)[0]).withColumn("place", F.lit(0))
        short = one if short is None else short.unionByName(one)
    windows = cut_lineage(hashed.unionByName(short).withColumn("window", F.concat_ws(" ", "words")))
    index = cut_lineage(windows.select("print", "place", "length", "window").distinct())
    return index, windows.select("window", "text_key").distinct()


def prints(words: Column, short: list[int], window: int = WINDOW, k: int = K) -> Column:
    """Distinct kept hashes of a document and its hashes for the lengths of short items."""
    parts = [F.array_distinct(kept_hashes(words, window, k))] + [
        F.when(F.size(words) >= n, F.array_distinct(gram_hashes(words, n))).otherwise(F.array().cast("array<bigint>")) for n in short
    ]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def places(words: Column, short: list[int], window: int = WINDOW, k: int = K) -> Column:
    """(print, at, length) where each kept hash begins, once for each place."""
    wide = window - k + 1
    kept = F.when(F.size(words) < window, F.array().cast("array<struct<print:bigint,at:int,length:int>>")).otherwise(
        let(gram_hashes(words, k), lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - wide + 1), lambda i: let(
            F.slice(h, i, wide), lambda s: let(F.array_min(s), lambda m: F.struct(
                m.alias("print"), (i - 1 + F.array_position(s, m) - 1).cast("int").alias("at"), F.lit(window).alias("length")
            ))
        )))))
    parts = [kept] + [F.when(F.size(words) < n, F.array().cast("array<struct<print:bigint,at:int,length:int>>")).otherwise(F.transform(
        gram_hashes(words, n), lambda h, i: F.struct(h.alias("print"), i.cast("int").alias("at"), F.lit(n).alias("length"))
    )) for n in short]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def covered(spans: Column) -> Column:
    """Words inside the union of (begin, end) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(F.sort_array(spans), start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")
    ), lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated.

    First, documents that keep any hash of the benchmark are found from their distinct hashes;
    then the places of those hashes are joined to the index and extended to windows, word by word.
    """
    items = cut_lineage(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    index, holders = benchmark_index(items, window, k)
    short = sorted(r[0] for r in index.filter(F.col("length") < window).select("length").distinct().collect())
    made = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    kept = docs.drop(*[c for c in docs.columns if c.lower() in made and c not in (doc_id, text)])
    key = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_key")]

    seen = kept.select(*key, F.explode(let(item_words(F.col(text)), lambda w: prints(w, short, window, k))).alias("print"))
    found = cut_lineage(seen.join(small(index.select("print").distinct()), "print", "left_semi").select("_id", "_key").distinct())
    texts = kept.select(*key, item_words(F.col(text)).alias("words")).join(small(found), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    hits = texts.withColumn("place_", F.explode(let(F.col("words"), lambda w: places(w, short, window, k)))).select(
        "_id", "_key", "words", F.col("place_.print").alias("print"), F.col("place_.at").alias("at"), F.col("place_.length").alias("length"))
    begin = F.col("at") - F.col("place")
    matched = hits.join(small(index), ["print", "length"]).filter(
        (begin >= 0) & (begin + F.col("length") <= F.size("words"))
        & (F.concat_ws(" ", F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("length"))) == F.col("window"))
    ).select("_id", "_key", F.struct(begin.alias("begin"), (begin + F.col("length")).alias("end")).alias("span"), "window")
    matched = cut_lineage(matched)
    hit = matched.groupBy("_id", "_key").agg(covered(F.collect_set("span")).alias("_hit"))
    named = items.withColumn("text_key", F.sha2(F.concat_ws(" ", item_words(F.col("text"))), 256)).select("item_id", "text_key").distinct()
    which = matched.select("_id", "_key", "window").distinct().join(small(cut_lineage(holders)), "window").select("_id", "_key", "text_key").distinct()
    listed = which.join(small(cut_lineage(named)), "text_key").groupBy("_id", "_key").agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    result = cut_lineage(hit.join(listed, ["_id", "_key"]))
    n_words = F.size(item_words(F.col(text))).cast("long")
    keyed = kept.select("*", n_words.alias("n_words"), *key)
    items_ = F.coalesce("_items", F.array().cast("array<string>"))
    return keyed.join(small(result), ["_id", "_key"], "left").withColumns({
        "n_hit": F.coalesce("_hit", F.lit(0)).cast("long"), "n_items": F.size(items_).cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", items_), 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("_id", "_key", "_hit", "_items")
