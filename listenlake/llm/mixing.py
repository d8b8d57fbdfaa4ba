"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is a stream of words: its documents in the order of a keyed hash.  The
stream is cut into blocks; a source whose target exceeds its size is passed over
more than once.  Exact block quotas of all sources are split from shard range to
shard range down a binary tree, every split a multivariate-hypergeometric draw;
each shard then takes its own blocks of a permuted sequence and orders them by hash.

Null text has no words and is taken no times; null is a source of its own, ordered
last.  Rows that are alike in source, id and text are separate documents.  An empty
table gives an empty mix.  Columns of `docs` other than the id, text and source
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.text import let, small, words
from listenlake.session import cut_lineage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words to take, and how often a source may be used at most.
SHARE, MOST_PASSES = 1.5, 2
#: Words of a block, and of an output shard.
BLOCK, SHARD = 4096, 8_000_000
#: Tables of one row per source are broadcast up to so many sources.
MANY_SOURCES = 10_000
SEED = 20240501
#: A prime above any number of blocks: coprime to all, so multiplying by it permutes.
PRIME = 2147483647


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Per source: rank, weight, source_size and target words.

    `sizes` has one row per source.  Targets share the total by weight; what exceeds `most`
    times a source's size is shared again by the others.  Sources are filled in the order of
    size per weight, so prefix sums give the level at which the water stands.  One row per
    source is all that meets in a window; sources are named by whoever sets weights.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int")).cast("double")
    )
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    full = most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (total - full) / left)
    capped = level.withColumn("_is_full", most * F.col("source_size") <= F.col("_level") * F.col("weight"))
    water = F.max(F.when(~F.col("_is_full"), F.col("_level"))).over(everything)
    return capped.select("source", "rank", "weight", "source_size", F.least(
        most * F.col("source_size").cast("double"), F.coalesce(water * F.col("weight"), most * F.col("source_size").cast("double"))
    ).alias("target"))


def streams(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """Where each document of the stored table `sized` (row, doc_id, source, size, row_hash) starts in its source's stream.

    Prefix sums in two steps: sums per hash bucket of a source, then inside the bucket, so no
    task gets a whole source.  A bucket holds about the square root of the source's documents.
    """
    per_source = cut_lineage(sized.groupBy("source").agg(F.count("*").alias("_rows")))
    spread = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("p._rows")))).cast("int")
    dealt = sized.alias("d").join(
        small(per_source, MANY_SOURCES).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left"
    ).select("d.*", (F.shiftrightunsigned(F.col("d.row_hash"), 33) % spread).alias("_bucket"))
    sums = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    by_bucket = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(by_bucket), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("row_hash", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.alias("l").join(offsets.alias("o"), (
        F.col("l.source").eqNullSafe(F.col("o.source")) & (F.col("l._bucket") == F.col("o._bucket"))
    ), "left").select("l.row", "l.doc_id", "l.source", "l.size", (F.col("l._local") + F.col("o._offset")).alias("start"))


def hypergeometric(total: Column, marked: Column, drawn: Column, unit: Column) -> Column:
    """Marked items among `drawn` of `total` without replacement, by inversion of `unit` in [0, 1).

    The support is cut to ten standard deviations around the mean, where all but 1e-20 lies.
    """
    mean = drawn * marked / F.greatest(total, F.lit(1))
    deviation = F.sqrt(F.greatest(mean * (1 - marked / F.greatest(total, F.lit(1))), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - 10 * deviation - 2)).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + 10 * deviation + 2)).cast("long")

    def ratio(k):
        return (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - marked - drawn + k + 1))

    def draw(bounds):
        steps = F.sequence(bounds["low"], bounds["high"])
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("found"))
        whole = F.aggregate(steps, start, lambda a, k: F.struct(
            (a["weight"] * ratio(k)).alias("weight"), (a["sum"] + a["weight"]).alias("sum"), a["found"].alias("found")
        ), lambda a: a["sum"])
        return let(whole, lambda sum_: F.aggregate(steps, start, lambda a, k: F.struct(
            (a["weight"] * ratio(k)).alias("weight"), (a["sum"] + a["weight"]).alias("sum"),
            F.when((a["found"] < 0) & (a["sum"] + a["weight"] > unit * sum_), k).otherwise(a["found"]).alias("found"),
        ), lambda a: F.when(a["found"] < 0, bounds["high"]).otherwise(a["found"])))

    return let(F.struct(low.alias("low"), high.alias("high")), draw)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (shard, rank, blocks): the quotas of all sources split among `shards` shards.

    `quotas` has (rank, blocks).  A node covers a range of shards and is one row with the quota
    of each source; its left half gets its exact share of the node's blocks, each source's part
    drawn in turn from what is left.  Nodes of a level are dealt over tasks.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("blocks").cast("long").alias("blocks")))).alias("q")).select(
        F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("width"), "q"
    )
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
    level, depth = 1, 0
    while level < shards:
        half = F.floor((F.col("width") + 1) / 2).cast("long")
        wide = node.withColumns({"n": total(F.col("q")), "half": half})
        # Which of the node's blocks go left: an exact share, rounded down.
        wide = wide.withColumn("go", F.when(F.col("width") < 2, F.col("n")).otherwise(F.floor(F.col("n") * F.col("half") / F.col("width")).cast("long")))

        def step(a, x):
            unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(depth), F.col("shard"), x["rank"]), 11) / float(2 ** 53)
            return let(hypergeometric(a["n"], x["blocks"], a["go"], unit), lambda k: F.struct(
                (a["n"] - x["blocks"]).alias("n"), (a["go"] - k).alias("go"),
                F.concat(a["left"], F.array(F.struct(x["rank"].alias("rank"), k.alias("blocks")))).alias("left"),
            ))

        empty = F.array().cast("array<struct<rank:int,blocks:bigint>>")
        drawn = F.aggregate("q", F.struct(F.col("n").alias("n"), F.col("go").alias("go"), empty.alias("left")), step, lambda a: a["left"])
        wide = wide.withColumn("left", F.when(F.col("width") < 2, F.col("q")).otherwise(drawn))
        right = F.zip_with("q", "left", lambda a, b: F.struct(a["rank"].alias("rank"), (a["blocks"] - b["blocks"]).alias("blocks")))
        parts = F.filter(F.array(
            F.struct(F.col("shard").alias("shard"), F.least("half", "width").alias("width"), F.col("left").alias("q")),
            F.struct((F.col("shard") + F.col("half")).alias("shard"), (F.col("width") - F.col("half")).alias("width"), right.alias("q")),
        ), lambda x: x["width"] > 0)
        node = wide.select(F.inline(parts))
        level, depth = level * 2, depth + 1
        if depth % 4 == 0:
            node = cut_lineage(node.repartition(min(level, 256), "shard"))
    return node.select("shard", F.inline("q")).filter("blocks > 0")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", row: str | None = None, weights=WEIGHTS,
        share: float = SHARE, block: int = BLOCK, shard_words: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of `docs`: pieces and documents.

    Pieces: shard, position (order inside the shard), row, doc_id, from_word, to_word: the words
    [from_word, to_word) of one pass over a document.  Documents: one row per row of `docs` with size,
    source_size and target of its source; every row counts, taken or not.  `row` numbers the rows of
    `docs`: the column of that name, the same whenever it is read, or else numbers given here.
    A source gets its target rounded to whole words: the last block of its quota is cut there.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    # Rows alike in id and text are interchangeable, so the mix does not depend on their numbers.
    sized = cut_lineage(docs.select(
        number.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("row_hash"),
    ))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share))
    documents = cut_lineage(streams(sized, seed).alias("d").join(
        small(targets, MANY_SOURCES).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left",
    ).select("d.*", "t.rank", "t.source_size", "t.target", F.round("t.target").cast("long").alias("quota")))
    blocks = targets.select("rank", F.ceil(F.round("target") / block).cast("long").alias("blocks")).filter("blocks > 0")
    shards = max(1, -(-int(targets.agg(F.sum("target")).first()[0] or 0) // shard_words))

    # The words of a pass that the quota covers, as places in one sequence of all passes.
    begin = F.col("pass") * F.col("source_size") + F.col("start")
    passes = documents.filter("size > 0 and quota > 0").withColumn(
        "pass", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_size")).cast("int")))
    ).withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota"))).filter("begin < end")
    pieces = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))).select(
        "row", "doc_id", "rank", "block",
        (F.greatest(F.col("block") * block, F.col("begin")) - F.col("begin")).alias("from_word"),
        (F.least((F.col("block") + 1) * block, F.col("end")) - F.col("begin")).alias("to_word"),
    )
    leaves = split_quotas(blocks, shards, seed)
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = leaves.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).select(
        "shard", "rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("turn")
    )
    factor, shift = F.lit(PRIME) % F.col("blocks"), F.pmod(F.xxhash64(F.lit(seed), "rank"), F.col("blocks"))
    placed = places.join(blocks, "rank").select("shard", "rank", ((factor * F.col("turn") + shift) % F.col("blocks")).alias("block"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "rank", "block", "from_word", "row")
    dealt = pieces.join(placed, ["rank", "block"]).select(
        "shard", F.row_number().over(order).alias("position"), "row", "doc_id", "from_word", "to_word"
    )
    return dealt, documents.select("row", "doc_id", "source", "size", "source_size", "target")


def taken_words(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    """`documents` with `taken`: the words its pieces hold, repeats counted."""
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return documents.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """Rows of `docs`, a stored table, repeated as often as the mix takes them, as whole texts with all their columns.

    Only the document at the edge of a source's quota is rounded.  A row is known by a hash of its id, source
    and text, below zero, so texts stay where they are; only rows that share a hash are stored, with a number each.
    """
    row = "_row"
    while row.lower() in {c.lower() for c in docs.columns}:
        row = "_" + row
    numbered = docs.withColumn(row, -1 - F.shiftrightunsigned(F.xxhash64(doc_id, source, text), 1))
    again = cut_lineage(numbered.groupBy(row).count().filter("count > 1").select(row))
    if not again.isEmpty():
        alike = cut_lineage(numbered.join(small(again), row, "left_semi").withColumn(row, F.monotonically_increasing_id()))
        numbered = numbered.join(small(again), row, "left_anti").unionByName(alike)
    pieces, documents = mix(numbered, text, source, doc_id, row=row, **options)
    copies = cut_lineage(taken_words(pieces, documents).filter("size > 0").select(
        "row", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")
    ).filter("times > 0"))
    joined = numbered.alias("s").join(small(copies).alias("c"), F.col(f"s.{row}") == F.col("c.row"))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("c.times")))
    return joined.select(*[F.col(f"s.`{c}`") for c in docs.columns], repeated.alias(row)).select(*docs.columns)
