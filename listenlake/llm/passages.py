"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? and their like in other scripts, also with closing quotes
or brackets behind them, and blanks, and at line ends); a sentence of more than LONG words is cut
again behind each word whose hash is the least of some GAP words in a row.  So no piece in there is
longer than GAP words, and a passage is cut alike wherever it stands, but for under GAP words at
each end.  From every piece on, the shortest run of at least RUN pieces and WORDS words is a span.
Spans are joined over all documents by hash; the first occurrence, in the order of document id and
place, stays, and the pieces under any later one go.

Null text stays null and empty text empty.  Texts shorter than a span stay whole.  Rows that share
an id are told apart by their text; rows alike in both are one document here and keep or lose the
same.  An empty table stays empty; extra columns are kept, columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm import bytewords
from listenlake.llm.postings import FREQUENT, Frequent, Packer, ranges_for, unpack
from listenlake.llm.text import small
from listenlake.llm.workers import send_package
from listenlake.session import cut_lineage

RUN, WORDS, LONG = 3, 20, 16
#: In a long sentence each run of so many words has a word that ends a piece.
GAP = 6
#: Ids that are no numbers are numbered so many a task.
KEYS_PER_TASK = 200_000

# Signs that end a sentence, and signs that may stand between such an end and the blank.
ENDS, CLOSERS = ".!?…。！？．｡؟۔।॥։።‼⁇⁈⁉", "\"')]}*_”’»›“‘」』）】》〉"


def _coded(signs: str) -> list[np.ndarray]:
    """UTF-8 bytes of the signs of one, two and three bytes, each as a number."""
    coded = [x.encode() for x in signs]
    return [np.array([int.from_bytes(x, "big") for x in coded if len(x) == n], dtype=np.int64) for n in (1, 2, 3)]


_ENDS, _CLOSERS = _coded(ENDS), _coded(CLOSERS)
_ENDS_PLAIN = np.zeros(256, dtype=bool)
_ENDS_PLAIN[_ENDS[0]] = True
#: Last bytes of words that have to be looked at more closely.
_MAY_END = np.zeros(256, dtype=bool)
_MAY_END[[x.encode()[-1] for x in ENDS + CLOSERS]] = True
_MAY_END &= ~_ENDS_PLAIN
_NEWLINE = 10
_TURN = np.uint64(0x9E3779B97F4A7C15)


def ends_sentence(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words end with a sentence end, closing quotes and brackets behind it left aside."""
    ends = _ENDS_PLAIN[data[end - 1]]
    at = np.flatnonzero(_MAY_END[data[end - 1]])
    low, stop = start[at], end[at]
    while len(at):
        code, length = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for n in (1, 2, 3):
            code += np.where(stop - n >= low, data[np.maximum(stop - n, 0)].astype(np.int64) << (8 * (n - 1)), 0)
            ends[at[np.isin(code, _ENDS[n - 1])]] = True
            length[np.isin(code, _CLOSERS[n - 1])] = n
        more = (length > 0) & (stop - length > low)
        at, low, stop = at[more], low[more], (stop - length)[more]
    return ends


def least_of_windows(value: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which values are the least, the last of equal ones, of some GAP values in a row of their group.

    Groups begin at `first` and have `size` values; those of under GAP have none.
    """
    count = np.maximum(size - GAP + 1, 0)
    window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    best = window.copy()
    for j in range(1, GAP):
        best = np.where(value[window + j] <= value[best], window + j, best)
    chosen = np.zeros(len(value), dtype=bool)
    chosen[best] = True
    return chosen


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in a row: start, end and hash of each, and the number of the piece it is in.

    Pieces do not cross texts.
    """
    start, end, doc = bytewords.spans(~bytewords.IS_GAP[data], offsets)
    value = bytewords.hashes(data, start, end)
    if not len(start):
        return start, end, value, doc
    lines = np.concatenate(([0], np.cumsum(data == _NEWLINE)))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | ends_sentence(data, start[:-1], end[:-1]) | (lines[start[1:]] > lines[end[:-1]])
    sentence = np.cumsum(new) - 1
    size = np.bincount(sentence)
    # Inside a long sentence a chosen word ends a piece; the choice looks at under GAP words on each side.
    chosen = least_of_windows(value, np.flatnonzero(new), np.where(size > LONG, size, 0))
    new[1:] |= chosen[:-1]
    return start, end, value, np.cumsum(new) - 1


def spans_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Per span: text, first piece inside the text, pieces in it and hash; then the words and pieces they are made of."""
    data, offsets = bytewords.flat(texts)
    start, end, value, piece = pieces(data, offsets)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, (data, start, end, piece, none, none)
    first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
    owner = np.searchsorted(offsets, start[first], side="right") - 1
    size = np.diff(np.concatenate((first, [len(start)])))
    # Order-bound sums: the hash of a run is a difference of prefix sums, turned back to its beginning.
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(value) - 1, _TURN, dtype=np.uint64))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(value) - 1, pow(int(_TURN), -1, 1 << 64), dtype=np.uint64))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(value * power, dtype=np.uint64)))
    before = np.concatenate(([0], np.cumsum(size)))
    n = len(first)
    place = np.arange(n)
    last = np.maximum(place + RUN, np.searchsorted(before, before[:-1] + WORDS, side="left"))
    bound = np.searchsorted(owner, np.arange(len(texts) + 1), side="left")
    fits = last <= bound[owner + 1]
    place, last = place[fits], last[fits]
    a, b = before[place], before[last]
    hashed = bytewords.mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
    return owner[place], place - bound[owner[place]], last - place, hashed.view(np.int64), (data, start, end, piece, first, bound)


def each_round(batch: pa.RecordBatch):
    """Nodes of the texts of a round and its spans; a hash that a text repeats appears once for each place."""
    for lo, hi in bytewords.rounds(batch.column("text")):
        node = batch.column("node").slice(lo, hi - lo).to_numpy()
        owner, place, length, hashed, _ = spans_of(batch.column("text").slice(lo, hi - lo))
        yield node, owner, place, length, hashed.view(np.uint64)


@bytewords.tidy
def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts and spans, and hashes that are frequent in a task, with their counts."""
    finder = Frequent()
    texts = spans = 0

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([0] * len(found), pa.int64())] * 2 + [
            pa.array([x[k].view(np.int64).tolist() for x in found], pa.list_(pa.int64())) for k in range(2)],
            names=["texts", "spans", "often", "count"])

    for batch in batches:
        for node, owner, _, _, hashed in each_round(batch):
            texts, spans = texts + len(node), spans + len(hashed)
            often = list(finder.add(len(node), hashed, node[owner]))
            if often:
                yield rows(often)
    often = list(finder.flush())
    if often:
        yield rows(often)
    yield pa.RecordBatch.from_arrays([pa.array([texts]), pa.array([spans]), *[pa.nulls(1, pa.list_(pa.int64()))] * 2],
                                     names=["texts", "spans", "often", "count"])


def covered_pieces(node: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, piece) of every piece that a span covers."""
    length = length.astype(np.int64)
    first = np.cumsum(length) - length
    return np.repeat(node, length), np.repeat(place.astype(np.int64) - first, length) + np.arange(int(length.sum()))


def disjoint(node: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (node, place, length) over the same pieces that do not overlap."""
    order = np.lexsort((place, node))
    node, place = node[order], place[order].astype(np.int64)
    stop = place + length[order]
    if not len(node):
        return node, place, stop
    rank = np.cumsum(np.concatenate(([False], node[1:] != node[:-1]))).astype(np.int64) << 32
    before = np.maximum.accumulate(rank + stop)[:-1]
    place[1:] = np.maximum(rank[1:] + place[1:], before) - rank[1:]
    new = place < stop
    return node[new], place[new], (stop - place)[new]


def pieces_of_nodes(owner: np.ndarray, covered: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each node once, with its pieces."""
    order = np.lexsort((covered, owner))
    owner, covered = owner[order], covered[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (covered[1:] != covered[:-1])
    owner, covered = owner[new], covered[new]
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
    return pa.array(owner[begin]), pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(owner)])), pa.int32()), pa.array(covered, pa.int32()))


def split_first(hashed: np.ndarray, node: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(hash, node, place, length) of the first place of each hash, and (node, place, length) of all later ones."""
    order = np.lexsort((place, node, hashed))
    hashed, node, place, length = (x[order] for x in (hashed, node, place, length))
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = hashed[1:] != hashed[:-1]
    # Rows alike share node and place: what repeats the first place is first as well.
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (node != node[begin]) | (place != place[begin])
    return tuple(x[new] for x in (hashed, node, place, length)), tuple(x[later] for x in (node, place, length))


@bytewords.tidy
def pack_spans(ranges: int, frequent: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed spans, and (node, pieces) under frequent ones that are not the first of their task.

    Of a frequent hash a task packs its first place alone, whatever the order of its documents.
    """
    packer = Packer(ranges, exact=True)
    held = None

    def rows(packed):
        columns = [pa.array([x[k] for x in packed], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        nothing = [pa.nulls(len(packed), t) for t in (pa.int64(), pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, *nothing], names=["range", "count", "packed", "node", "pieces"])

    for batch in batches:
        for node, owner, place, length, hashed in each_round(batch):
            who = node[owner]
            at = np.minimum(np.searchsorted(frequent, hashed), max(len(frequent) - 1, 0))
            hot = frequent[at] == hashed if len(frequent) else np.zeros(len(hashed), dtype=bool)
            if hot.any():
                here = tuple(x[hot] for x in (hashed, who, place, length))
                held, later = split_first(*(here if held is None else map(np.concatenate, zip(held, here))))
                if len(later[0]):
                    changed, covered = pieces_of_nodes(*covered_pieces(*disjoint(*later)))
                    nothing = [pa.nulls(len(changed), t) for t in (pa.int64(), pa.int64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*nothing, changed, covered], names=["range", "count", "packed", "node", "pieces"])
            packed = list(packer.add(hashed[~hot], who[~hot], place[~hot], length[~hot]))
            if packed:
                yield rows(packed)
    packed = [*(packer.add(*held) if held else ()), *packer.flush()]
    if packed:
        yield rows(packed)


def later_in_range(by_node: int, table: pa.Table) -> pa.Table:
    """All but the first span of each hash of one range, packed anew by node."""
    low, node, place, length = unpack(table.column("count").to_pylist(), table.column("packed").to_pylist(), 2, exact=True)
    owner, place, length = split_first(low, node, place, length)[1]
    order = np.argsort(owner, kind="stable")
    owner, place, length = owner[order], place[order], length[order]
    packer = Packer(by_node)
    packed = [*packer.add(bytewords.mixed(owner.astype(np.uint64)), owner, place, length), *packer.flush()]
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.table({name: pa.array([x[k] for x in packed], kinds[k]) for k, name in enumerate(("range", "count", "packed"))})


def pieces_in_range(table: pa.Table) -> pa.Table:
    """(node, pieces) of the nodes of one range, from their spans."""
    _, node, place, length = unpack(table.column("count").to_pylist(), table.column("packed").to_pylist(), 2)
    changed, covered = pieces_of_nodes(*covered_pieces(*disjoint(node, place, length)))
    return pa.table({"node": changed, "pieces": covered})


@bytewords.tidy
def remove_pieces(columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the pieces in `_gone` cut out of their text, and how many pieces and words went.

    What separates a removed piece from the next goes with it; every kept byte stays in its order.
    """
    for batch in batches:
        text, gone = batch.column("text"), batch.column("_gone").to_pylist()
        new, n_pieces, n_words = text.to_pylist(), [0] * len(gone), [0] * len(gone)
        for i in [i for i, x in enumerate(gone) if x]:
            one = text.slice(i, 1)
            data, offsets = bytewords.flat(one)
            start, _, _, piece = pieces(data, offsets)
            count = int(piece[-1]) + 1
            first = start[np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))]
            edge = np.concatenate((first, [len(data)]))
            keep = np.ones(count, dtype=bool)
            keep[[x for x in gone[i] if x < count]] = False
            size = np.bincount(piece, minlength=count)
            parts = [data[:edge[0]]] + [data[edge[k]:edge[k + 1]] for k in np.flatnonzero(keep)]
            new[i] = np.concatenate(parts).tobytes().decode("utf-8").rstrip() if keep.any() else ""
            n_pieces[i], n_words[i] = int((~keep).sum()), int(size[~keep].sum())
        out = {**{c: batch.column(c) for c in columns}, "text": pa.array(new, pa.string()),
               "n_removed": pa.array(n_pieces, pa.int64()), "n_removed_words": pa.array(n_words, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` with repeated passages removed from the column `text` in all but their first place, n_removed and n_removed_words.

    A span moves as a hash, its document's number and its place, packed.  Spans of more than FREQUENT of
    all documents move once a task: each task drops all but its own first place where they are, and the
    first of these is found like that of any other span.
    """
    send_package(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    counts = plain.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if dict(docs.dtypes)[doc_id] in ("bigint", "int") and counts[0] == counts[1]:
        # Whole-number ids that do not repeat are numbers already.
        nodes = None
        texts = plain.select(F.col("doc_id").cast("long").alias("node"), "text")
    else:
        nodes = numbered(plain.select("doc_id", "row").distinct())
        texts = plain.alias("p").join(small(nodes).alias("n"), F.col("p.doc_id").eqNullSafe(F.col("n.doc_id")) & (
            F.col("p.row") == F.col("n.row"))).select("node", "text")
    seen = cut_lineage(texts.mapInArrow(describe, (
        "texts long, spans long, often array<long>, count array<long>")))
    whole = seen.agg(F.sum("texts"), F.sum("spans")).first()
    frequent = seen.select(F.inline(F.arrays_zip("often", "count"))).groupBy("often").agg(F.sum("count").alias("count")).filter(
        F.col("count") >= FREQUENT / 2 * (whole[0] or 0)).select("often").toArrow()
    hashes = np.sort(frequent.column("often").to_numpy().view(np.uint64))
    packed = cut_lineage(texts.mapInArrow(partial(pack_spans, ranges_for(whole[1] or 0), hashes), (
        "range long, count long, packed binary, node long, pieces array<int>")))
    by_node = ranges_for((whole[1] or 0) // 2)
    by_hash = packed.filter("range is not null").select("range", "count", "packed").groupBy("range").applyInArrow(
        lambda table: later_in_range(by_node, table), "range long, count long, packed binary")
    later = by_hash.groupBy("range").applyInArrow(pieces_in_range, "node long, pieces array<int>").unionByName(packed.filter("range is null").select("node", "pieces"))
    gone = later.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("pieces"))).alias("_gone"))
    columns = [c for c in docs.columns if c.lower() not in ("n_removed", "n_removed_words")]
    source = docs.select(*columns).alias("s")
    if nodes is None:
        joined = source.join(cut_lineage(gone).alias("g"), F.col(f"s.{doc_id}") == F.col("g.node"), "left")
    else:
        known = cut_lineage(gone.join(small(nodes), "node").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_gone"))
        joined = source.join(known.alias("g"), F.col(f"s.{doc_id}").eqNullSafe(F.col("g._id")) & (
            F.xxhash64("s.text") == F.col("g._row")), "left")
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    return joined.select("s.*", "g._gone").mapInArrow(partial(remove_pieces, columns), f"{kinds}, n_removed long, n_removed_words long")


def numbered(keys: DataFrame) -> DataFrame:
    """`keys` (doc_id, row) with `node`, growing with doc_id: a range-sorted table numbered partition by partition."""
    count = keys.count()
    ordered = keys.repartitionByRange(max(1, count // KEYS_PER_TASK), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return cut_lineage(ordered.withColumn("node", F.monotonically_increasing_id()))
