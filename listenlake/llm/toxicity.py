"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character model of order ORDER is counted over every word of the corpus.  Tokens that
look written around a filter (digits or signs for letters, runs of one letter, letters
set apart by blanks or signs) are decoded: each character may stand for itself, for the
letters it resembles, or for nothing, a sign or blank also for the end of a word, and Viterbi
picks the likeliest words; runs of letters between signs count as words besides.  The score is
1 - (1 - base) * product(1 - p) over the distinct telling words of the restored text,
where p is a word's smoothed share of toxic documents among those that hold it.

Null text is empty; an empty text has the base score.  Only labelled rows outside the
held-out fold are learnt from; without any, every score is 0.  Rows alike get equal scores;
rows that share an id are scored each by its own text.  An empty table gives no rows.
Label, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm import bytewords
from listenlake.llm.workers import send_package
from listenlake.session import cut_lineage

ORDER = 4
#: Letters a to z, the edge of a word, and any other character: the model's whole alphabet.
SYMBOLS = 28
EDGE, OTHER = 26, 27
#: At most about so many labelled rows are learnt from, chosen by hash.
LABELLED_ROWS = 400_000
#: A telling word occurs in so many learnt documents at least, and its smoothed toxic share is so high.  Their
#: number is bounded by the labelled rows learnt from (LABELLED_ROWS), each word being in LEAST_DOCS of them.
LEAST_DOCS, LEAST_SHARE = 5, 0.5
SMOOTHING = 4.0
REJECT = 0.7
# The letters a character is written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
#: Costs in nats: a character for a letter it resembles, one left out, a repeated letter left out, a plain sign for nothing or a word's end.
SUBSTITUTE, OMIT, OMIT_REPEAT, SIGN = 1.0, 3.0, 0.7, 0.1
#: Decoded tokens a worker remembers, and the longest of them.
REMEMBER, REMEMBER_LENGTH = 200_000, 48
#: Of a run of one character so many are looked at.
ALIKE = 3

_ALIKE = re.compile(rf"(?s)((.)\2{{{ALIKE - 1}}})\2+")

_SYMBOL = np.full(256, OTHER, dtype=np.int64)
_SYMBOL[97:123] = np.arange(26)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_STANDS = np.zeros(256, dtype=bool)
_STANDS[[ord(x) for x in LOOKS_LIKE if ord(x) < 128]] = True
#: Characters of two and three bytes that are no letters, marks or numbers.
_SIGN = np.array([i >= 128 and unicodedata.category(chr(i))[0] not in "LMN" for i in range(1 << 16)])


def letters_of(data: np.ndarray) -> np.ndarray:
    """Which lower-cased bytes are letters' bytes; signs outside ASCII are none."""
    letter = _LETTER[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    first, wide = data[lead].astype(np.int64), np.append(data, np.zeros(3, dtype=np.uint8)).astype(np.int64) & 63
    two, three = lead[first < 0xE0], lead[(first >= 0xE0) & (first < 0xF0)]
    # Pictures are in the planes behind F0 9F.
    four = lead[(first == 0xF0) & (data[lead + 1] == 0x9F)]
    two = two[_SIGN[(data[two].astype(np.int64) & 31) << 6 | wide[two + 1]]]
    three = three[_SIGN[(data[three].astype(np.int64) & 15) << 12 | wide[three + 1] << 6 | wide[three + 2]]]
    for size, found in ((2, two), (3, three), (4, four)):
        for j in range(size):
            letter[found + j] = False
    return letter


def letters_only(letter: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the signs and digits around their letters; a span without letters becomes empty."""
    place = np.flatnonzero(letter)
    if not len(place):
        return start, start
    low = np.searchsorted(place, start, side="left")
    high = np.searchsorted(place, end, side="left") - 1
    some = high >= low
    return np.where(some, place[np.minimum(low, len(place) - 1)], start), np.where(some, place[np.maximum(high, 0)] + 1, start)


@bytewords.tidy
def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character runs of length ORDER over all words, one sparse row set per task."""
    total = np.zeros(SYMBOLS ** ORDER, dtype=np.int64)
    for batch in batches:
        for first, last in bytewords.rounds(batch.column("text")):
            data, offsets = bytewords.flat(batch.column("text").slice(first, last - first))
            data = bytewords.LOWER[data]
            start, end, _ = bytewords.spans(~bytewords.IS_GAP[data], offsets)
            start, end = letters_only(letters_of(data), start, end)
            start, end = start[end > start], end[end > start]
            # Words one after the other, each behind ORDER - 1 edges and before one.
            length = end - start + ORDER
            at = np.concatenate(([0], np.cumsum(length)))
            coded = np.full(at[-1], EDGE, dtype=np.int64)
            inner = np.repeat(start - (at[:-1] + ORDER - 1), end - start)
            place = np.arange(int((end - start).sum())) + np.repeat(at[:-1] + ORDER - 1 - np.concatenate(([0], np.cumsum(end - start)))[:-1], end - start)
            coded[place] = _SYMBOL[data[place + inner]]
            if len(coded) < ORDER:
                continue
            gram = sum(coded[j:len(coded) - ORDER + 1 + j] * SYMBOLS ** (ORDER - 1 - j) for j in range(ORDER))
            last_of = np.zeros(len(coded), dtype=bool)
            last_of[:] = True
            for j in range(ORDER - 1):
                last_of[at[:-1] + j] = False
            total += np.bincount(gram[last_of[ORDER - 1:]], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


class CharModel:
    """Costs of a character after the ORDER - 1 before it, with absolute back-off to shorter contexts."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
        share = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for order in range(1, ORDER + 1):
            table = counts.sum(axis=tuple(range(ORDER - order)))
            context = table.sum(axis=-1, keepdims=True)
            kinds = (table > 0).sum(axis=-1, keepdims=True)
            share = (table + np.maximum(kinds, 1) * share) / (context + np.maximum(kinds, 1))
        self.cost = -np.log(share)


def choices(token: str) -> list[list[tuple[int, str, float]]]:
    """The lattice of a token: per character the (symbol, letter, cost) it may be; -1 leaves it out, EDGE ends a word."""
    lattice = []
    for i, x in enumerate(token):
        here = []
        if "a" <= x <= "z":
            here.append((ord(x) - 97, x, 0.0))
            if i and token[i - 1] == x:
                here.append((-1, "", OMIT_REPEAT))
        elif x in LOOKS_LIKE:
            here += [(ord(y) - 97, y, SUBSTITUTE) for y in LOOKS_LIKE[x]]
            here += [(-1, "", OMIT_REPEAT if i and token[i - 1] == x else OMIT), (EDGE, " ", OMIT)]
        elif x.isalpha():
            here.append((OTHER, x, 0.0))
        else:
            here += [(-1, "", SIGN), (EDGE, " ", SIGN)]
        lattice.append(here)
    return lattice


def decode(model: CharModel, token: str) -> str:
    """The likeliest words behind a token, set apart by blanks: Viterbi over (previous characters) states."""
    cost = model.cost
    begin = (EDGE,) * (ORDER - 1)
    # A word so far is a chain of its last letter and what is before it, so that a step costs the same at any length.
    states = {begin: (0.0, None)}
    for here in choices(token):
        after: dict[tuple, tuple[float, tuple | None]] = {}
        for state, (paid, word) in states.items():
            for symbol, letter, price in here:
                if symbol < 0 or (symbol == EDGE and state == begin):
                    key, value, add = state, paid + price, False
                elif symbol == EDGE:
                    key, value, add = begin, paid + price + cost[state + (EDGE,)], True
                else:
                    key, value, add = state[1:] + (symbol,), paid + price + cost[state + (symbol,)], True
                if key not in after or value < after[key][0]:
                    after[key] = (value, (word, letter) if add else word)
        states = after
    word = min(((paid + (0.0 if state == begin else cost[state + (EDGE,)]), state, word) for state, (paid, word) in states.items()), key=lambda x: x[:2])[2]
    letters = []
    while word is not None:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters)).strip()


class Restorer:
    """Words of texts with disguised ones decoded."""

    def __init__(self, counts: np.ndarray):
        self.model, self.known = CharModel(counts), {}

    def decoded(self, token: str) -> str:
        token = _ALIKE.sub(r"\1", token)
        if len(token) > REMEMBER_LENGTH:
            return decode(self.model, token)
        if token not in self.known:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[token] = decode(self.model, token)
        return self.known[token]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """Lower-cased bytes, start, end and text of every plain word, and (text, word) of every decoded one."""
        data, offsets = bytewords.flat(texts)
        data = bytewords.LOWER[data]
        start, end, doc = bytewords.spans(~bytewords.IS_GAP[data], offsets)
        letter = letters_of(data)
        n = np.concatenate(([0], np.cumsum(letter)))
        letters = n[end] - n[start]
        core, stop = letters_only(letter, start, end)
        # A sign of disguise: between the letters, or in front of them, something else; or a letter three times.
        inside = (stop - core) != letters
        euro = np.zeros(len(data) + 1, dtype=bool)
        euro[3:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC) if len(data) > 2 else False
        front = (core > start) & (_STANDS[data[np.maximum(core - 1, 0)]] | euro[core]) & (letters > 0)
        run = np.zeros(len(data) + 1, dtype=np.int64)
        if len(data) > 2:
            run[3:] = np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:])
        long_run = (run[stop] - run[np.minimum(core + 2, stop)] > 0) & (letters > 2)
        size = stop - core
        odd = (inside | front | long_run) & (letters > 0)
        # Letters set apart by blanks: three or more one-letter words in a row.
        single = (size == 1) & (end - start <= 2) & (letters == 1)
        found: list[tuple[int, str]] = []
        for i in np.flatnonzero(odd):
            token = data[start[i]:end[i]].tobytes().decode("utf-8", "ignore").rstrip("!?.,;:*#%&$|()[]\"'")
            found += [(int(doc[i]), w) for w in self.decoded(token).split()]
            if inside[i]:
                # Words joined by signs, as they stand: runs cut only at signs that stand for no letter and are no
                # apostrophe, and kept only where they hold letters alone ('idiot,moron' gives both words, '!d!ot' and
                # "it's" none besides their decoding).
                part = letter[core[i]:stop[i]] | _STANDS[data[core[i]:stop[i]]] | (data[core[i]:stop[i]] == 39)
                edge = core[i] + np.flatnonzero(np.diff(part, prepend=False, append=False))
                found += [
                    (int(doc[i]), data[a:b].tobytes().decode("utf-8", "ignore"))
                    for a, b in zip(edge[::2], edge[1::2])
                    if b - a > 1 and letter[a:b].all()
                ]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            # A run may go over the end of a text.
            cuts = [a, *(a + 1 + np.flatnonzero(np.diff(doc[a:b]))), b]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo >= 3:
                    found += [(int(doc[lo]), w) for w in self.decoded(" ".join(chr(data[core[k]]) for k in range(lo, hi))).split()]
        plain = ~odd & (size > 0)
        return data, core[plain], stop[plain], doc[plain], found


_restorers: dict[str, Restorer] = bytewords.remembered({})


def restorer(shared) -> Restorer:
    """One restorer per worker process and model."""
    key = str(shared.value[0])
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(shared.value[1])
    return _restorers[key]


@bytewords.tidy
def count_words(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents, toxic documents) of each batch of labelled texts; the empty word counts all documents."""
    reader = restorer(shared)
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        for first, last in bytewords.rounds(batch.column("text")):
            texts = batch.column("text").slice(first, last - first)
            data, start, end, doc, found = reader.words(texts)
            names = bytewords.cut(data, start, end).dictionary_encode()
            values = names.dictionary.to_pylist()
            number = {x: i for i, x in enumerate(values)}
            code = names.indices.to_numpy().astype(np.int64) if len(names) else np.zeros(0, dtype=np.int64)
            extra_doc = np.array([d for d, _ in found], dtype=np.int64)
            extra = np.array([number.setdefault(w, len(number)) for _, w in found], dtype=np.int64)
            pair = np.unique(np.concatenate((code, extra)) * len(texts) + np.concatenate((doc, extra_doc)))
            word, owner = pair // max(len(texts), 1), pair % max(len(texts), 1)
            docs = np.bincount(word, minlength=len(number))
            bad = np.bincount(word, weights=toxic[first:last][owner], minlength=len(number)).astype(np.int64)
            rows = [("", len(texts), int(toxic[first:last].sum()))] + [(w, int(docs[i]), int(bad[i])) for w, i in number.items() if w]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                             names=["word", "docs", "toxic"])


@bytewords.tidy
def score_batches(shared, base: float, weights: dict[str, float], columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`columns` of each row with its score."""
    reader = restorer(shared)
    hashes = np.array([bytewords.word_hash(w) for w in weights], dtype=np.uint64)
    order = np.argsort(hashes)
    hashes, value = hashes[order], np.array(list(weights.values()))[order]
    number = {w: int(np.flatnonzero(order == i)[0]) for i, w in enumerate(weights)} if len(weights) else {}
    for batch in batches:
        scores = []
        for first, last in bytewords.rounds(batch.column("text")):
            texts = batch.column("text").slice(first, last - first)
            data, start, end, doc, found = reader.words(texts)
            keep = np.log1p(-base) * np.ones(len(texts))
            if len(hashes):
                word = bytewords.hashes(data, start, end)
                at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
                hit = hashes[at] == word
                pairs = np.concatenate((doc[hit] * len(hashes) + at[hit], np.array([d * len(hashes) + number[w] for d, w in found if w in number], dtype=np.int64)))
                pairs = np.unique(pairs)
                np.add.at(keep, pairs // len(hashes), np.log1p(-value[pairs % len(hashes)]))
            scores.append(1.0 - np.exp(keep))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*columns, "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def char_counts(texts: DataFrame) -> np.ndarray:
    """Character runs of all texts; the table's size is that of the alphabet, whatever the corpus."""
    send_package(texts.sparkSession)
    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count_grams, "gram long, n long")
    total = np.zeros(SYMBOLS ** ORDER, dtype=np.int64)
    rows = counts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return total


def telling_words(docs: DataFrame, labels: DataFrame, shared, rows: int = LABELLED_ROWS) -> tuple[float, dict[str, float]]:
    """Base share of toxic documents, and the words that tell with their shares, from labels outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, rows / max(known.count(), 1))
    chosen = cut_lineage(known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(share * 2 ** 53)))
    # Bounded by `rows`, so small enough for every task.
    texts = docs.join(F.broadcast(chosen.limit(rows + rows // 10)), "doc_id").select("toxic", F.col("text").cast("string").alias("text"))
    words = texts.mapInArrow(partial(count_words, shared), "word string, docs long, toxic long").groupBy("word").agg(
        F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    words = cut_lineage(words.filter((F.col("word") == "") | ((F.col("docs") >= LEAST_DOCS) & (2 * F.col("toxic") >= F.col("docs")))))
    whole = words.filter("word = ''").first()
    if whole is None or not whole["docs"]:
        return 0.0, {}
    base = whole["toxic"] / whole["docs"]
    best = words.filter("word <> ''").withColumn("share", (F.col("toxic") + SMOOTHING * base) / (F.col("docs") + SMOOTHING)).filter(
        F.col("share") >= LEAST_SHARE).collect()
    # A share of one would hide every other word.
    return min(base, 0.5), {r["word"]: min(r["share"], 1 - 1e-6) for r in best}


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = REJECT) -> DataFrame:
    """`docs` with held_out, score and predicted.

    Three passes over the texts: the corpus's character counts, words of labelled documents, scores.
    What goes from pass to pass is bounded: SYMBOLS ** ORDER counts and the telling words of at most
    LABELLED_ROWS labelled rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = char_counts(plain)
    shared = spark.sparkContext.broadcast((float(counts.sum()) + hash(counts.tobytes()) % 1000003 / 1e7, counts.astype(np.float32)))
    base, weights = telling_words(plain, labels, shared)
    rest = docs.drop(*[c for c in docs.columns if c.lower() in ("held_out", "score", "predicted")])
    columns = rest.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    source = rest if text == "text" else rest.withColumn("text", F.col(text))
    scored = source.mapInArrow(partial(score_batches, shared, base, weights, columns), f"{kinds}, score double")
    return scored.withColumn("held_out", held_out(F.col(doc_id))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
