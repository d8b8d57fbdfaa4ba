"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set are its distinct shingles of SHINGLE words, lower-cased in A-Z; with fewer
words the whole sequence is the one shingle; without words the set is empty and links with
nothing.  Two documents link when their sets' Jaccard similarity is at least PERCENT / 100.
Equal sets form one class and are compared once.

Null text has no words.  Rows that share an id are compared each by its own text.  An empty
table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm import bytewords
from listenlake.llm.graph import connected_components
from listenlake.llm.postings import FREQUENT, Frequent, Packer, ranges_for, unpack
from listenlake.llm.text import small
from listenlake.llm.workers import send_package
from listenlake.session import cut_lineage, remove, stored

SHINGLE, PERCENT = 5, 75
#: Largest set for which subsets may be chosen.
MOST_LIGHT = 12
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Common shingles two sets of these sizes need to link."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int = PERCENT) -> range:
    return range(max(1, -(-percent * n // 100)), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets a set of `n` shingles may have to share."""
    return sorted({c for m in partner_sizes(n, percent) if (c := least_overlap(n, m, percent)) <= min(n, m)})


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of so many of its rarest shingles, a set of size `n` has one in common with every set it links with."""
    return n - -(-percent * n // 100) + 1


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin."""
    data, offsets = bytewords.flat(texts)
    data = bytewords.LOWER[data]
    start, end, doc = bytewords.spans(~bytewords.IS_GAP[data], offsets)
    word = bytewords.hashes(data, start, end)
    first = np.searchsorted(doc, np.arange(len(texts) + 1), side="left")
    count = np.diff(first)
    found, owner = [], []
    if len(word) >= shingle:
        value = sum(word[j:len(word) - shingle + 1 + j] * _FACTORS[j] for j in range(shingle))
        same = doc[:len(word) - shingle + 1] == doc[shingle - 1:]
        found.append(bytewords.mixed(value[same]))
        owner.append(doc[:len(word) - shingle + 1][same])
    for n in range(1, shingle):
        few = np.flatnonzero(count == n)
        if len(few):
            value = sum(word[first[few] + j] * _FACTORS[j] for j in range(n))
            found.append(bytewords.mixed(value + _FACTORS[shingle + n]))
            owner.append(few)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(texts) + 1), side="left")


def signatures(found: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, equal for equal sets."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(bytewords.mixed(found ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
    return out[0], out[1]


def lists_of(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values.view(np.int64)))


@bytewords.tidy
def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and signature of each document's set; rows of size -1 hold hashes that are frequent in a task, with counts."""
    finder, kind = Frequent(), None

    def rows(found):
        nothing = [pa.nulls(len(found), t) for t in (kind, pa.int64())]
        return pa.RecordBatch.from_arrays([
            *nothing, pa.array([-1] * len(found), pa.int64()), *[pa.nulls(len(found), pa.int64())] * 2,
            *[pa.array([x[k].view(np.int64).tolist() for x in found], pa.list_(pa.int64())) for k in (0, 1)]],
            names=["doc_id", "text_hash", "n", "sig_a", "sig_b", "often", "count"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for first, last in bytewords.rounds(batch.column("text")):
            found, begin = shingle_sets(batch.column("text").slice(first, last - first))
            a, b = signatures(found, begin)
            nothing = pa.nulls(last - first, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(first, last - first) for c in ("doc_id", "text_hash")], pa.array(np.diff(begin)), pa.array(a), pa.array(b),
                 nothing, nothing], names=["doc_id", "text_hash", "n", "sig_a", "sig_b", "often", "count"])
            often = list(finder.add(last - first, found))
            if often:
                yield rows(often)
    often = list(finder.flush())
    if often:
        yield rows(often)


def own_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes, hashes and beginnings of the sets whose signature is that of the row's class.

    Another text under the same id has another signature and is left out.
    """
    for first, last in bytewords.rounds(batch.column("text")):
        found, begin = shingle_sets(batch.column("text").slice(first, last - first))
        a, b = signatures(found, begin)
        column = lambda name: batch.column(name).slice(first, last - first).to_numpy()
        right = (a == column("sig_a")) & (b == column("sig_b"))
        if not right.all():
            found = found[np.repeat(right, np.diff(begin))]
            begin = np.concatenate(([0], np.cumsum(np.diff(begin)[right])))
        yield column("node")[right], found, begin


@bytewords.tidy
def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, found, begin in own_sets(batch):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.diff(begin)), lists_of(found, begin)], names=["node", "n", "hashes"])


PACKED = "range long, count long, packed binary, node long, n long, hot array<long>"


def packed_rows(packed: list[tuple], more: int) -> pa.RecordBatch:
    columns = [pa.array([x[k] for x in packed], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    nothing = [pa.nulls(len(packed), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()))][:more]
    return pa.RecordBatch.from_arrays([*columns, *nothing], names=["range", "count", "packed", "node", "n", "hot"][:3 + more])


@bytewords.tidy
def pack_sets(ranges: int, frequent: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings (hash, node, size, frequent hashes in the set), and one row per node with frequent hashes (no range)."""
    packer = Packer(ranges)
    for batch in batches:
        for node, found, begin in own_sets(batch):
            n = np.diff(begin)
            owner = np.repeat(np.arange(len(node)), n)
            place = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
            hot = frequent[place] == found if len(frequent) else np.zeros(len(found), dtype=bool)
            at = np.searchsorted(owner[hot], np.arange(len(node) + 1), side="left")
            some = np.diff(at) > 0
            if some.any():
                nothing = [pa.nulls(int(some.sum()), t) for t in (pa.int64(), pa.int64(), pa.binary())]
                own = np.concatenate(([0], np.cumsum(np.diff(at)[some])))
                yield pa.RecordBatch.from_arrays([*nothing, pa.array(node[some]), pa.array(n[some]), lists_of(found[hot], own)],
                                                 names=["range", "count", "packed", "node", "n", "hot"])
            owner = owner[~hot]
            packed = list(packer.add(found[~hot], node[owner], n[owner], np.diff(at)[owner]))
            if packed:
                yield packed_rows(packed, 3)
    packed = list(packer.flush())
    if packed:
        yield packed_rows(packed, 3)


def shared_in_range(ranges: int, key: tuple, table: pa.Table) -> pa.Table:
    """Postings of the hashes of one range that several nodes have, packed anew by node."""
    low, node, n, hot = unpack(table.column("count").to_pylist(), table.column("packed").to_pylist(), 2)
    order = np.argsort(low, kind="stable")
    low, node, n, hot = low[order], node[order], n[order], hot[order]
    begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    df = np.diff(np.concatenate((begin, [len(low)])))
    df = np.repeat(df, df)
    keep = df > 1
    low, node, n, hot, df = low[keep], node[keep], n[keep], hot[keep], df[keep]
    order = np.argsort(node, kind="stable")
    packer = Packer(ranges)
    packed = [*packer.add(bytewords.mixed(node.astype(np.uint64))[order], node[order], n[order], hot[order], df[order],
                          np.full(len(node), key[0].as_py()), low[order].view(np.int32)), *packer.flush()]
    return pa.Table.from_batches([packed_rows(packed, 0)])


def rarest_of_nodes(table: pa.Table) -> pa.Table:
    """Per node of a range: size, shared hashes, and the rarest of them with how many shared ones each begins."""
    _, node, n, hot, df, number, low = unpack(table.column("count").to_pylist(), table.column("packed").to_pylist(), 5)
    value = (number.astype(np.int64) << np.int64(32)) | low.view(np.uint32).astype(np.int64)
    order = np.lexsort((value, df, node))
    node, n, hot, value = node[order], n[order].astype(np.int64), hot[order].astype(np.int64), value[order]
    begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    found = np.diff(np.concatenate((begin, [len(node)])))
    n, hot = n[begin], hot[begin]
    # What no other node has comes first in the order and takes its part of the prefix.
    keep = n - -(-PERCENT * n // 100) + 1 - (n - found - hot)
    taken = np.clip(keep, 0, found)
    at = np.concatenate(([0], np.cumsum(taken)))
    inside = np.arange(at[-1]) - np.repeat(at[:-1], taken)
    left = np.repeat(found + hot, taken) - inside
    return pa.table({"node": node[begin], "n": n, "found": found, "more": np.maximum(keep - found, 0),
                     "kept": lists_of(value[np.repeat(begin, taken) + inside].view(np.uint64), at),
                     "left": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(left))})


@bytewords.tidy
def subsets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, c, key): every subset of c shingles that a small set may share with a partner."""
    for batch in batches:
        node, size, c_, keys = [], [], [], []
        for x, hashes in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist()):
            for c in subset_sizes(len(hashes)):
                chosen = np.array(list(combinations(hashes, c)), dtype=np.int64).view(np.uint64)
                value = bytewords.mixed((bytewords.mixed(chosen) * _FACTORS[:c]).sum(axis=1, dtype=np.uint64))
                keys.append(value.view(np.int64))
                node += [x] * len(value)
                size += [len(hashes)] * len(value)
                c_ += [c] * len(value)
        keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(c_, pa.int32()), pa.array(keys)],
                                         names=["node", "n", "c", "key"])


def choose_boundary(counts: dict[int, int]) -> int:
    """The size up to which subsets cost less than lists, from the number of sets of each small size."""
    def cost(b: int) -> float:
        light = sum(k * sum(comb(n, c) for c in subset_sizes(n)) for n, k in counts.items() if n <= b)
        return light + sum(k * 2 * n for n, k in counts.items() if n > b or 100 * n >= PERCENT * (b + 1))
    return min(range(MOST_LIGHT + 1), key=cost)


def light_edges(sets: DataFrame) -> DataFrame:
    """Links among small sets.

    All sets on one key have c shingles in common; they link if their sizes are small enough for c,
    so each that links with any links with the smallest: a star keeps every connection.
    """
    keyed = sets.mapInArrow(subsets_of, "node long, n long, c int, key long")
    centre = keyed.groupBy("c", "key").agg(F.min(F.struct("n", "node")).alias("centre"), F.count("*").alias("met")).filter("met > 1")
    need = F.ceil(PERCENT * (F.col("n") + F.col("centre.n")) / float(100 + PERCENT))
    return keyed.join(centre, ["c", "key"]).filter((F.col("node") != F.col("centre.node")) & (need <= F.col("c"))).select(
        F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").filter(
        100 * common >= PERCENT * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def candidate_lists(packed: DataFrame, ranges: int, nodes: int) -> DataFrame:
    """Rows (hash, node, n, score, left): the prefix of each set in the order of document frequency, as far as it is shared.

    A set of size n has, among its prefix_length(n) rarest hashes, one in common with every set it links
    with.  Hashes of one set only come first in that order and meet nobody; the frequent ones come last.
    `left` counts the shared hashes from this one on: no more can be in common with a set met here first.
    """
    by_node = ranges_for(nodes * 256)
    shared = packed.filter("range is not null").select("range", "count", "packed").groupBy("range").applyInArrow(
        lambda key, table: shared_in_range(by_node, key, table), "range long, count long, packed binary")
    rarest = shared.groupBy("range").applyInArrow(
        rarest_of_nodes, "node long, n long, found long, more long, kept array<long>, left array<long>")
    info = packed.filter("range is null").select(F.col("node"), F.col("n").alias("n_"), "hot").dropDuplicates(["node"])
    both = rarest.join(info, "node", "full").withColumn("hot", F.coalesce("hot", F.array().cast("array<bigint>")))
    n = F.coalesce("n", "n_")
    # A set that shares frequent hashes alone.
    alone = n - F.ceil(n * PERCENT / 100.0) + 1 - (n - F.size("hot"))
    more = F.least(F.coalesce("more", F.greatest(alone, F.lit(0))), F.size("hot"))
    # A frequent hash keeps its bits and a negative sign, apart from the numbers of the ranges.
    last = F.slice(F.array_sort(F.transform("hot", lambda x: -1 - F.shiftrightunsigned(x, 1))), 1, more.cast("int"))
    hot = F.transform(last, lambda x, i: F.struct(x.alias("hash"), (F.size("hot") - i).cast("long").alias("left")))
    rare = F.transform(F.arrays_zip("kept", "left"), lambda x: F.struct(x["kept"].alias("hash"), x["left"].alias("left")))
    nothing = F.array().cast("array<struct<hash:bigint,left:bigint>>")
    return cut_lineage(both.select("node", n.alias("n"), (F.coalesce("found", F.lit(0)) + F.size("hot")).alias("score"), F.inline(
        F.concat(F.coalesce(rare, nothing), hot))))


def may_link(n: Column, m: Column, left: Column, other: Column) -> Column:
    """Sizes and what is left of both sets allow a link."""
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * F.least(left, other) >= PERCENT * (n + m))


def heavy_edges(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among large sets, enough to connect what is connected.

    First each list is compared with its most central set; only sets that are then still apart are
    compared with each other.
    """
    pivot = lists.groupBy("hash").agg(F.max(F.struct("score", (-F.col("node")).alias("node_"), "n", "left")).alias("p"), F.count("*").alias("met")).filter("met > 1")
    other = -F.col("p.node_")
    near = lists.join(pivot, "hash").filter((F.col("node") != other) & may_link(F.col("n"), F.col("p.n"), F.col("left"), F.col("p.left"))).select(
        F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()
    first = cut_lineage(verified(near, sets))
    labels = connected_components(first)
    placed = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = cut_lineage(placed)
    apart = placed.groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("hash")
    divided = cut_lineage(placed.join(apart, "hash", "left_semi"))
    rest = divided.alias("a").join(divided.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.node") < F.col("b.node")) & (
        F.col("a.label") != F.col("b.label")) & may_link(F.col("a.n"), F.col("b.n"), F.col("a.left"), F.col("b.left"))).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    return first.unionByName(verified(rest, sets))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id (smallest id reachable by links) and class_id (smallest id with the same set)."""
    send_package(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = cut_lineage(plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        describe, f"doc_id {kind}, text_hash long, n long, sig_a long, sig_b long, often array<long>, count array<long>"))
    described = scanned.filter("n >= 0").drop("often", "count")
    # Rows alike in id and text would bring a set more than once.
    repeated = described.count() > described.select("doc_id", "text_hash").distinct().count()
    signature = ["n", "sig_a", "sig_b"]
    classes = cut_lineage(described.filter("n > 0").groupBy(*signature).agg(F.min("doc_id").alias("class_id")).withColumn(
        "node", F.monotonically_increasing_id()))
    sizes = dict(classes.filter(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect())
    boundary = choose_boundary(sizes)
    heavy = classes.filter(F.col("n") >= -(-PERCENT * (boundary + 1) // 100))

    # At most 2 * (mean set size) / FREQUENT hashes can be this frequent.
    frequent = scanned.filter("n < 0").select(F.inline(F.arrays_zip("often", "count"))).groupBy("often").agg(F.sum("count").alias("count")).filter(
        F.col("count") >= FREQUENT / 2 * described.count()).toArrow().column("often").to_numpy()
    frequent = np.sort(frequent.view(np.uint64))
    postings, nodes = (x or 0 for x in heavy.agg(F.sum("n"), F.count("*")).first())
    ranges = ranges_for(postings)

    def texts(wanted: DataFrame) -> DataFrame:
        """One text of each class in `wanted`, with the class."""
        return plain.join(small(wanted.select(F.col("class_id").alias("doc_id"), "node", "sig_a", "sig_b")), "doc_id").select("text", "node", "sig_a", "sig_b")

    def sets(wanted: DataFrame) -> DataFrame:
        made = texts(wanted).mapInArrow(whole_sets, "node long, n long, hashes array<long>")
        return made.dropDuplicates(["node"]) if repeated else made

    # Postings and sets are the size of the texts: each goes from the disk when what is made of it is stored.
    packed, packed_path = stored(texts(heavy).mapInArrow(partial(pack_sets, ranges, frequent), PACKED))
    lists = candidate_lists(packed, ranges, nodes)
    remove(docs.sparkSession, packed_path)
    reached = cut_lineage(classes.join(small(cut_lineage(lists.select("node").distinct())), "node", "left_semi"))
    large_sets, large_path = stored(sets(reached))
    small_sets, small_path = stored(sets(classes.filter(F.col("n") <= boundary)))
    labels = connected_components(heavy_edges(lists, large_sets).unionByName(light_edges(small_sets)))
    for path in (large_path, small_path):
        remove(docs.sparkSession, path)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    final = cut_lineage(named.join(smallest, "label").select(*signature, "class_id", "component_id"))
    return described.join(small(final), signature, "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each component, that of the smallest id; documents without words all stay.

    Rows alike in id and text count as one; a null id stays.
    """
    found = jaccard_components(docs, doc_id, text).filter("n_shingles = 0 or doc_id is null or component_id = doc_id")
    keep = cut_lineage(found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count("*").alias("_rows"), F.max("n_shingles").alias("_n"), F.min("class_id").alias("_class")))
    # Two texts of one set under one id: the smaller hash stays.
    one = keep.filter("_n > 0 and _id is not null").groupBy("_id", "_n", "_class").agg(F.min("_hash").alias("_hash"), F.sum("_rows").alias("_rows"))
    keep = cut_lineage(one.select("_id", "_hash", (F.col("_rows") > 1).alias("_again")).unionByName(
        keep.filter("_n = 0 or _id is null").select("_id", "_hash", F.lit(False).alias("_again"))))
    kept = docs.join(small(keep), F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_hash"))).drop("_id", "_hash")
    again = kept.filter("_again").dropDuplicates([doc_id, text])
    return kept.filter("not _again").unionByName(again).drop("_again") if not keep.filter("_again").isEmpty() else kept.drop("_again")
