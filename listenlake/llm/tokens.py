"""Token-id output: shards of separately compressed documents under one shared zstandard dictionary.

Null text is empty and gives the end id alone.  Rows with one id keep all their
copies, next to each other in no stated order; a null id comes first.  An empty
table gives an empty dataset without shards.  Other columns are not read.

A shard file: MAGIC, the compressed documents one after the other, an index as an
Arrow table (doc_id, offset, bytes, n_tokens), then a fixed tail: index length,
id width, SHA-256 of the dictionary, MAGIC.  One document is read with two range reads.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenlake.llm import bytewords
from listenlake.llm.workers import send_package
from listenlake.session import cut_lineage, remove, scratch_path, stored

MAGIC = b"TOKSHRD1"
TAIL = struct.Struct("<QB32s8s")
END_ID = 2
LEVEL = 3
#: Tokens of a shard, documents the dictionary is trained on, its bytes, and the bytes of each document it sees.
SHARD_TOKENS, SAMPLE_DOCS, DICTIONARY_BYTES, SAMPLE_BYTES = 8_000_000, 1_000, 65_536, 16_384
#: Parts a worker remembers the ids of, by a 64-bit hash, from one encoding task to the next; beyond it, or so many
#: ids a part, it starts anew.  Late ones are merged at so many.
REMEMBER, REMEMBER_IDS, LATE = 1_000_000, 8, 32_768
#: Parts the library is asked for at once, as one text with a word between them whose id tells where each ends.
ASK, MARK = 256, "0"

# Letters, digits, apostrophe and other signs of ASCII; bytes of other characters are 3, those of Latin-1 letters 0 (`kinds`).
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[:128] = 2
_KIND[48:58] = 1
_KIND[97:123] = 0
_BAR, _QUOTE = ord("|"), ord("'")
# First byte of U+00C0 to U+00FF, and the second of the two of them that are no letters.
_LATIN, _TIMES, _DIVIDED = 0xC3, 0x97, 0xB7

_workers: dict[str, "Encoder"] = bytewords.remembered({})


def kinds(data: np.ndarray) -> np.ndarray:
    """What each byte of valid UTF-8 is part of; capital Latin-1 letters become one small letter each, so they count as such."""
    kind = _KIND[data]
    lead = np.flatnonzero(data == _LATIN)
    lead = lead[(data[lead + 1] != _TIMES) & (data[lead + 1] != _DIVIDED)]
    kind[lead] = kind[lead + 1] = 0
    return kind


class Encoder:
    """Ids of whole texts from the library's ids of their distinct parts.

    Texts are cut where the tokenizer always cuts: at white space and between a letter or a digit
    and another ASCII character.  Latin-1 letters count as letters.  Words with an apostrophe or a bar stay in one
    piece, as rules and special tokens may reach across; other characters beyond ASCII stay with their neighbours.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Tasks are what runs side by side; threads of the library would only add CPU time and memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.count, self.used = 0, 0
        self.ids, self.at = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 12, dtype=np.int64)
        # Known parts by hash, sorted: a large table and a small one of late parts, merged now and then.
        self.tables = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))] * 2

    def find(self, value: np.ndarray) -> np.ndarray:
        """Number of each part by its hash, -1 where it is not known."""
        number = np.full(len(value), -1, dtype=np.int64)
        for known, numbers in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                here = known[at] == value
                number[here] = numbers[at[here]]
        return number

    def ask(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part.  Parts that hold the mark, or a bar, as special tokens do, are asked for one by one."""
        found: list[np.ndarray | None] = [None] * len(parts)
        plain = [k for k, x in enumerate(parts) if MARK not in x and "|" not in x] if self.mark is not None else []
        for k in range(0, len(plain), ASK):
            some = plain[k:k + ASK]
            asked = self.tokenizer.encode_batch_fast([f" {MARK} ".join([parts[i] for i in some])], add_special_tokens=False)
            ids = np.array(asked[0].ids, dtype=np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(some) - 1:
                for i, a, b in zip(some, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]):
                    found[i] = ids[a:b]
        left = [k for k, x in enumerate(found) if x is None]
        # The library's own results are large, so they are taken a few at a time.
        for k in range(0, len(left), 16 * ASK):
            some = left[k:k + 16 * ASK]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([parts[i] for i in some], add_special_tokens=False)):
                found[i] = np.array(x.ids, dtype=np.uint32)
        return found

    def learn(self, value: np.ndarray, parts: list[str]) -> np.ndarray:
        """Ask the library for the ids of new parts; returns their numbers."""
        found = self.ask(parts)
        fresh = np.concatenate(found)
        while self.used + len(fresh) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.count + len(parts) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[self.used:self.used + len(fresh)] = fresh
        self.at[self.count + 1:self.count + 1 + len(parts)] = self.used + np.cumsum([len(x) for x in found])
        number = np.arange(self.count, self.count + len(parts))
        self.count, self.used = self.count + len(parts), self.used + len(fresh)
        main, late = self.tables[0], merged(self.tables[1], (value, number))
        self.tables = [main, late] if len(late[0]) < LATE else [merged(main, late), (value[:0], number[:0])]
        return number

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> list[np.ndarray]:
        data, offsets = bytewords.flat(texts)
        data = bytewords.LOWER[data]
        inside = ~bytewords.IS_GAP[data]
        start, end, _ = bytewords.spans(inside, offsets)
        kind = kinds(data)
        # A cut inside a word: two ASCII kinds meet, in a word without apostrophe or bar.
        meet = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            meet[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] < 3) & (kind[:-1] < 3) & inside[1:] & inside[:-1]
        odd = np.concatenate(([0], np.cumsum((data == _BAR) | (data == _QUOTE))))
        whole = odd[end] > odd[start]
        for s, e in zip(start[whole], end[whole]):
            meet[s + 1:e] = False
        meet[offsets] = False
        extra = np.flatnonzero(meet)
        starts = np.sort(np.concatenate((start, extra)))
        ends = np.sort(np.concatenate((end, extra)))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        distinct, example, inverse = np.unique(bytewords.hashes(data, starts, ends), return_index=True, return_inverse=True)
        number = self.find(distinct)
        if (number < 0).any():
            if self.count and (self.count + np.count_nonzero(number < 0) > REMEMBER or self.used > REMEMBER_IDS * REMEMBER):
                self.forget()
                number[:] = -1
            new = number < 0
            number[new] = self.learn(distinct[new], bytewords.cut(data, starts[example[new]], ends[example[new]]).to_pylist())
        index = number[inverse]
        first, length = self.at[index], self.at[index + 1] - self.at[index]
        placed = np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(length, out=placed[1:])
        flat = self.ids[np.repeat(first - placed[:-1], length) + np.arange(placed[-1])]
        bounds = placed[np.searchsorted(doc, np.arange(len(texts) + 1), side="left")]
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        return [np.concatenate((flat[a:b], tail)) for a, b in zip(bounds[:-1], bounds[1:])]


def merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables (hash, number) as one, sorted by hash."""
    at = np.searchsorted(one[0], other[0])
    return np.insert(one[0], at, other[0]), np.insert(one[1], at, other[1])


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def id_type(wide: bool):
    return np.dtype("<u4") if wide else np.dtype("<u2")


@partial(bytewords.tidy, keep=(_workers,))
def encode_batches(path: str, end_id: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        text = batch.column("text")
        for first, last in bytewords.rounds(text):
            found = coder.encode(text.slice(first, last - first), end_id)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, last - first), batch.column("tie").slice(first, last - first),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([packer.compress(x.astype(id_type(coder.wide)).tobytes()) for x in found], pa.binary()),
            ], names=["doc_id", "tie", "n_tokens", "packed"])


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for documents like `samples`; empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def join_path(root: str, name: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return system, f"{path.rstrip('/')}/{name}"


@bytewords.tidy
def write_batches(root: str, dictionary: bytes, wide: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes one shard file per partition and yields its manifest row; a repeated task writes under another name."""
    from pyspark import TaskContext

    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_of(dictionary))
    reader = zstandard.ZstdDecompressor()
    shard, out, at, index, kind = TaskContext.get().partitionId(), None, len(MAGIC), [], None
    for batch in batches:
        if not len(batch):
            continue
        if out is None:
            system, path = join_path(root, name := f"shard-{shard:06d}-{uuid.uuid4().hex}.tok")
            out, kind = system.open_output_stream(path), batch.schema.field("doc_id").type
            out.write(MAGIC)
        frames = [packer.compress(reader.decompress(x)) for x in batch.column("packed").to_pylist()]
        sizes = np.array([len(x) for x in frames], dtype=np.int64)
        out.write(b"".join(frames))
        index.append(pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes), batch.column("n_tokens"),
        ], names=["doc_id", "offset", "bytes", "n_tokens"]))
        at += int(sizes.sum())
    if out is None:
        return
    table = pa.Table.from_batches(index)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    body = sink.getvalue().to_pybytes()
    out.write(body + TAIL.pack(len(body), 4 if wide else 2, hashlib.sha256(dictionary).digest(), MAGIC))
    out.close()
    yield pa.RecordBatch.from_arrays([
        pa.array([shard], pa.int64()), pa.array([name]), pa.array([table.num_rows], pa.int64()),
        pa.array([pa.compute.sum(table.column("n_tokens")).as_py()], pa.int64()),
    ], names=["shard", "name", "n_docs", "n_tokens"])


class Shard:
    """Reads documents of one shard file by position."""

    def __init__(self, root: str, name: str):
        system, path = join_path(root, name)
        self.file = system.open_input_file(path)
        size = self.file.size()
        length, width, digest, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        self.index = pa.ipc.open_stream(self.file.read_at(length, size - TAIL.size - length)).read_all()
        system, path = join_path(root, f"dictionary-{digest.hex()}.zdict")
        with system.open_input_stream(path) as stream:
            dictionary = stream.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {name} has changed")
        self.reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(dictionary))
        self.type = id_type(width == 4)
        self.offsets, self.sizes = (self.index.column(x).to_numpy() for x in ("offset", "bytes"))

    def ids(self, position: int) -> np.ndarray:
        return np.frombuffer(self.reader.decompress(self.file.read_at(int(self.sizes[position]), int(self.offsets[position]))), dtype=self.type)


@bytewords.tidy
def digest_batches(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
            shard = Shard(root, name)
            total, counts, sums = start, [], []
            for position in range(shard.index.num_rows):
                ids = shard.ids(position)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            counts = np.array(counts, dtype=np.int64)
            yield from pa.Table.from_arrays([
                shard.index.column("doc_id"), pa.array(total + np.cumsum(counts) - counts), pa.array(counts), pa.array(sums, pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches()


def write_tokens(docs: DataFrame, root: str, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end_id: int | None = END_ID,
                 shard_tokens: int = SHARD_TOKENS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Write `docs` as token shards below `root`, in ascending id order; returns the stored manifest.

    Ids are stored once before they are sorted, so that losing executors repeats no encoding.  The
    dictionary only shapes the compression: it is trained on about `sample_docs` documents, chosen by hash.  The manifest (shard, name, n_docs, n_tokens) names the files that count.
    """
    send_package(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"), F.col(text).cast("string").alias("text"))
    coded, coded_path = stored(plain.mapInArrow(partial(encode_batches, vocabulary, end_id), f"doc_id {kind}, tie long, n_tokens long, packed binary"))
    total, n_docs = (x or 0 for x in coded.agg(F.sum("n_tokens"), F.count("*")).first())
    # About `sample_docs` documents: those whose hash lies in the share of the hash range that holds so many.
    share = min(1.0, sample_docs / max(n_docs, 1))
    few = coded.filter(F.shiftrightunsigned(F.xxhash64("doc_id", "tie"), 11) < int(share * 2 ** 53)).limit(2 * sample_docs)
    reader = zstandard.ZstdDecompressor()
    dictionary = train_dictionary([reader.decompress(bytes(r[0]))[:SAMPLE_BYTES] for r in few.select("packed").collect()])
    system, path = join_path(root, f"dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict")
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as stream:
        stream.write(dictionary)
    wide = encoder(vocabulary).wide
    shards = max(1, -(-total // shard_tokens))
    ordered = coded.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = cut_lineage(ordered.mapInArrow(partial(write_batches, root, dictionary, wide), "shard long, name string, n_docs long, n_tokens long"))
    remove(docs.sparkSession, coded_path)
    return manifest


def read_tokens(manifest: DataFrame, root: str, id_kind: str = "bigint") -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens and the CRC-32 of its ids.

    One row per shard meets in the window that gives each shard its start.
    """
    send_package(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    started = manifest.select("shard", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    tasks = max(1, min(manifest.count(), 2000))
    return started.repartition(tasks).mapInArrow(partial(digest_batches, root), f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long")


def token_dataset(spark: SparkSession, docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write `docs` to a new folder of the shared scratch and read the digests back."""
    root = scratch_path(spark, "tokens")
    kind = dict(docs.dtypes)[options.get("doc_id", "doc_id")]
    return read_tokens(write_tokens(docs, root, vocabulary, **options), root, kind)
