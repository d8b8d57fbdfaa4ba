"""Postings (hash, node, more) that move between tasks packed by hash range, not row by row.

Hashes are nearly all different, so no sum before the shuffle makes them fewer; packed, a
posting takes about five bytes instead of forty.  Hashes that very many documents share never
move this way: they are found first, a bounded number of them, and are known to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

#: Postings of a range on average, and postings a task gathers before it packs them.
RANGE, FLUSH = 1_000_000, 500_000
#: A hash in more than this share of all documents counts as frequent.
FREQUENT = 0.005


def ranges_for(postings: int) -> int:
    return max(1, -(-postings // RANGE))


def range_of(value: np.ndarray, ranges: int) -> np.ndarray:
    return (((value >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


class Frequent:
    """Gathers postings of a task's documents and yields the hashes that are frequent among them.

    A yield holds (hashes, counts of documents), from every FLUSH postings on.  A hash in `share` of
    all documents is in half of that share at least in those flushes that hold half its occurrences, so
    sums of these counts do not miss it.  Flushes with few of a hash say nothing about it, so where
    it stands is not told here.
    """

    def __init__(self, share: float = FREQUENT):
        self.share, self.held, self.size, self.documents = share, [], 0, 0

    def add(self, documents: int, value: np.ndarray, *where: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Postings of so many more documents; without `where` (node), a document has a hash once."""
        self.held.append((value, *where))
        self.size += len(value)
        self.documents += documents
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[np.ndarray, ...]]:
        if not self.size:
            return
        value, *where = (np.concatenate(x) for x in zip(*self.held))
        least = max(8, self.share / 2 * self.documents)
        self.held, self.size, self.documents = [], 0, 0
        if where:
            order = np.lexsort((where[0], value))
            value, node = value[order], where[0][order]
            one = np.ones(len(value), dtype=bool)
            one[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])
            value = value[one]
        seen, count = np.unique(value, return_counts=True)
        yield seen[count >= least], count[count >= least]


class Packer:
    """Gathers postings and yields (range, count, packed) when there are enough, and at the end.

    Of a hash its low 32 bits are kept, or all 64 for `exact`: where chance meetings are checked
    later, one in a few thousand does no harm.
    """

    def __init__(self, ranges: int, exact: bool = False):
        self.ranges, self.held, self.size = ranges, [], 0
        self.type = np.uint64 if exact else np.uint32
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, value: np.ndarray, node: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        self.held.append((value, node, *more))
        self.size += len(value)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.size:
            return
        columns = [np.concatenate(x) for x in zip(*self.held)]
        self.held, self.size = [], 0
        number, low = range_of(columns[0], self.ranges), columns[0].astype(self.type)
        order = np.argsort(number, kind="stable")
        number, low, rest = number[order], low[order], [c[order] for c in columns[1:]]
        edges = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:]):
            node = rest[0][a:b]
            parts = [low[a:b].tobytes(), np.diff(node, prepend=np.int64(0)).tobytes(), *[c[a:b].astype(np.int32).tobytes() for c in rest[1:]]]
            yield int(number[a]), int(b - a), self.zip.compress(b"".join(parts))


def unpack(counts: list[int], blobs: list[bytes], more: int = 0, exact: bool = False) -> list[np.ndarray]:
    """Hash bits, node and `more` further columns of all packed postings of a range."""
    reader, columns = zstandard.ZstdDecompressor(), [[] for _ in range(2 + more)]
    kinds = [np.dtype(np.uint64 if exact else np.uint32), np.dtype(np.int64), *[np.dtype(np.int32)] * more]
    for n, blob in zip(counts, blobs):
        data, at = reader.decompress(blob), 0
        for k, kind in enumerate(kinds):
            columns[k].append(np.frombuffer(data, kind, n, at))
            at += n * kind.itemsize
        columns[1][-1] = np.cumsum(columns[1][-1])
    return [np.concatenate(c) for c in columns]
