"""Merkle manifest of a document table: leaves, subroots per source, one root, and proofs.

A leaf is H (lowercase hex sha256) of its fields doc_id, source, lang, n_chars, text, each
`-` if null, else its UTF-8 byte count, `:` and its value (integers in decimal), all
concatenated.  Per source, leaves ascend by doc_id (nulls first; equal ids by leaf); while
several nodes remain, every FANOUT consecutive ones (the last run fewer, even one) become H
of their digests as hex text.  What remains, a lone leaf itself, is the source's subroot;
subroots ordered by source (null first, UTF-8 bytewise) give the root alike.  A proof is H
of all siblings (the other members of a node's run), level by level from the leaf via its
subroot to the root, left to right.  Folding a leaf with its original siblings gives the
root back unless the leaf changed.

Method: positions come from a range-partitioned sort, each task numbering its rows and a
table of one row per (task, source) giving the offsets, so a source with a third of all
rows is numbered by many tasks.  Leaves are grouped by superblock, FANOUT^LEVELS aligned
consecutive leaves of a source.  A first pass reduces each superblock to its digest; the
digests of superblocks form the next, FANOUT^LEVELS times smaller level, worked on in the
same way, and the subroots a top tree.  Each superblock then gets the outer nodes it needs,
one row: the siblings of its path above it and the subroot and root.  Leaves and that row
are cogrouped by superblock in `applyInPandas`, where the local reduction is finished and
proofs are joined and tampered leaves folded together; no group holds more than
FANOUT^LEVELS leaves, and text never leaves the first projection.

Rows: repeated rows are leaves each (equal ids order by leaf, equal leaves are alike).
Null fields hash as `-`; null and empty text differ.  An empty table gives no rows.  Extra
columns are not carried; the result has its own columns only.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listenlake.llm.text import ascii_lower
from listenlake.llm.workers import send_package
from listenlake.session import cut_lineage

#: Nodes a run joins; levels a superblock spans.
FANOUT, LEVELS = 16, 3
#: Fields of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_PATHS = "g string, pos long, lefts array<string>, rights array<string>, top string"
_ROOTS = "g string, sb long, digest string"
RESULT = "doc_id long, source string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text the check alters: 5 divides the unsigned crc32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def positions(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`df` with `pos`, 0-based within `group` in `order`, numbered by all tasks of a range-partitioned sort."""
    ranged = df.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    ranged = cut_lineage(ranged.withColumn("_mk_part", F.spark_partition_id()).withColumn("_mk_row", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_mk_part", group).agg(F.count(F.lit(1)).alias("_mk_n"), F.min("_mk_row").alias("_mk_first"))
    before = Window.partitionBy(group).orderBy("_mk_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_mk_offset", F.coalesce(F.sum("_mk_n").over(before), F.lit(0)))
    joined = ranged.join(counts.withColumnRenamed(group, "_mk_g"), (ranged["_mk_part"] == counts["_mk_part"]) & ranged[group].eqNullSafe(F.col("_mk_g")))
    return joined.select(*[ranged[c] for c in df.columns], (F.col("_mk_offset") + ranged["_mk_row"] - F.col("_mk_first")).alias("pos"))


def levels_of(digests: list[str], forced: bool, depth: int = LEVELS) -> list[list[str]]:
    """The levels of a superblock from its nodes: `depth` of them where its group holds more, else until one node is left."""
    levels = [digests]
    while (len(levels) <= depth) if forced else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return levels


def sides(levels: list[list[str]], t: int) -> list[tuple[str, str]]:
    """Left and right siblings of node `t` at each level below the top of `levels`."""
    out = []
    for level in levels[:-1]:
        start = t - t % FANOUT
        out.append(("".join(level[start:t]), "".join(level[t + 1:start + FANOUT])))
        t //= FANOUT
    return out


def block_roots(depth: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the superblock's digest at its top level."""
    pdf = pdf.sort_values("pos")
    sb = int(pdf["sb"].iloc[0])
    top = levels_of(list(pdf["digest"]), sb > 0, depth)[-1][0]
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "sb": [sb], "digest": [top]})


def block_paths(depth: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Per node of a superblock: the siblings of its path within it and the superblock's digest."""
    pdf = pdf.sort_values("pos")
    sb = int(pdf["sb"].iloc[0])
    levels = levels_of(list(pdf["digest"]), sb > 0, depth)
    paths = [sides(levels, t) for t in range(len(pdf))]
    return pd.DataFrame({
        "g": pdf["g"].to_numpy(), "pos": pdf["pos"].to_numpy(),
        "lefts": [[a for a, _ in p] for p in paths], "rights": [[b for _, b in p] for p in paths], "top": levels[-1][0],
    })


def climb(nodes: DataFrame, depth: int = LEVELS) -> DataFrame:
    """Per node (g, pos, digest): the siblings of its path up to its group's top, and that top (g, pos, lefts, rights, top)."""
    block = FANOUT ** depth
    nodes = nodes.withColumn("sb", F.floor(F.col("pos") / block))
    local = nodes.groupBy("g", "sb").applyInPandas(partial(block_paths, depth), _PATHS)
    local = cut_lineage(local.withColumn("sb", F.floor(F.col("pos") / block)))
    roots = local.groupBy("g", "sb").agg(F.first("top").alias("digest"))
    several = roots.groupBy("g").agg(F.max("sb").alias("last")).filter("last > 0").select(F.col("g").alias("_mk_g"))
    upper = roots.join(several, roots["g"].eqNullSafe(several["_mk_g"])).select("g", F.col("sb").alias("pos"), "digest")
    upper = cut_lineage(upper)
    if upper.isEmpty():
        return local.select("g", "pos", "lefts", "rights", "top")
    above = climb(upper, depth).select(F.col("g").alias("_mk_g"), F.col("pos").alias("_mk_sb"), F.col("lefts").alias("_mk_l"),
                                F.col("rights").alias("_mk_r"), F.col("top").alias("_mk_top"))
    joined = local.join(above, local["g"].eqNullSafe(above["_mk_g"]) & (local["sb"] == above["_mk_sb"]), "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        "g", "pos", F.concat("lefts", F.coalesce("_mk_l", empty)).alias("lefts"), F.concat("rights", F.coalesce("_mk_r", empty)).alias("rights"),
        F.coalesce("_mk_top", "top").alias("top"),
    )


def finish(depth: int, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Leaves of one superblock with its outer row: proofs joined, tampered leaves folded, all in one pass."""
    if leaves.empty:
        return pd.DataFrame(columns=RESULT_COLUMNS)
    leaves = leaves.sort_values("pos")
    sb = int(leaves["sb"].iloc[0])
    levels = levels_of(list(leaves["leaf"]), sb > 0, depth)
    o = outer.iloc[0]
    outer_sides = list(zip(list(o["lefts"]), list(o["rights"])))
    proofs, folded = [], []
    for t, changed in enumerate(leaves["changed"]):
        path = sides(levels, t) + outer_sides
        proof = hashlib.sha256()
        node = changed
        for left, right in path:
            proof.update((left + right).encode())
            node = H(left + node + right)
        proofs.append(proof.hexdigest())
        folded.append(node)
    root = o["root"]
    return pd.DataFrame({
        "doc_id": leaves["doc_id"].to_numpy(), "source": leaves["g"].to_numpy(), "pos": leaves["pos"].to_numpy(),
        "leaf": leaves["leaf"].to_numpy(), "subroot": o["subroot"], "root": root, "proof_sha256": proofs,
        "folded_root": folded, "verified": [f == root for f in folded],
    })


RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def manifest(docs: DataFrame, depth: int = LEVELS) -> DataFrame:
    """Per row of `docs`: doc_id, source, pos, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf), verified.

    A superblock is FANOUT ** `depth` leaves.
    """
    send_package(docs.sparkSession)
    text = F.col("text")
    fields = [F.col(c) for c in FIELDS]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("g"), leaf_of(*fields).alias("leaf"),
        F.when(tampered(F.col("doc_id")), leaf_of(*fields[:4], ascii_lower(text))).otherwise(leaf_of(*fields)).alias("changed"),
    )
    leaves = positions(rows, "g", [F.col("doc_id").asc_nulls_first(), F.col("leaf")]).withColumn("sb", F.floor(F.col("pos") / FANOUT ** depth))
    roots = leaves.select("g", "sb", "pos", F.col("leaf").alias("digest")).groupBy("g", "sb").applyInPandas(partial(block_roots, depth), _ROOTS)
    roots = cut_lineage(roots)
    several = roots.groupBy("g").agg(F.max("sb").alias("last")).filter("last > 0").select(F.col("g").alias("_mk_g"))
    inner_nodes = roots.join(several, roots["g"].eqNullSafe(several["_mk_g"])).select("g", F.col("sb").alias("pos"), "digest")
    inner = climb(inner_nodes, depth).select(F.col("g").alias("_mk_g"), F.col("pos").alias("_mk_sb"), "lefts", "rights", "top")
    blocks = roots.join(inner, roots["g"].eqNullSafe(inner["_mk_g"]) & (roots["sb"] == inner["_mk_sb"]), "left").select(
        "g", "sb", F.coalesce("top", "digest").alias("subroot"), "lefts", "rights")
    blocks = cut_lineage(blocks)
    subroots = blocks.groupBy("g").agg(F.first("subroot").alias("digest"))
    top_nodes = positions(subroots.select(F.lit("").alias("t"), F.col("g").alias("source"), "digest"), "t", [F.col("source").asc_nulls_first()])
    top = climb(top_nodes.select(F.col("t").alias("g"), "pos", "digest"), depth)
    top = top.join(top_nodes.select(F.col("pos").alias("_mk_pos"), "source"), F.col("pos") == F.col("_mk_pos")).select(
        F.col("source").alias("_mk_g"), F.col("lefts").alias("_mk_tl"), F.col("rights").alias("_mk_tr"), F.col("top").alias("root"))
    empty = F.array().cast("array<string>")
    outer = blocks.join(top, blocks["g"].eqNullSafe(top["_mk_g"])).select(
        "g", "sb", "subroot", "root",
        F.concat(F.coalesce("lefts", empty), "_mk_tl").alias("lefts"), F.concat(F.coalesce("rights", empty), "_mk_tr").alias("rights"),
    )
    outer = cut_lineage(outer)
    return leaves.groupBy("g", "sb").cogroup(outer.groupBy("g", "sb")).applyInPandas(partial(finish, depth), RESULT)
