"""Chat formatting: token ids, text and loss mask of a conversation, and the way back.

A turn is written `### role: text </turn>` and a line end.  In role and text every
backslash and control string gets a backslash in front, in the role a colon too, so
an unescaped control string is always the template's.  Each segment is encoded by
itself and reserved ids above the vocabulary are spliced in between, so no text can
produce one.

Null role or text is empty.  Rows of one conversation are ordered by turn (null
first), then role and text; repeated rows stay and count.  A null conversation is one
of its own.  An empty table gives no conversations.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm import bytewords
from listenlake.llm.workers import send_package

#: The strings the template puts around role and text; the reserved ids follow this order above the vocabulary.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
#: The role whose texts are learnt from.
LEARNT = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_tokenizers: dict[str, object] = bytewords.remembered({})


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _CONTROL).sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1), text)


def tokenizer(path: str):
    """One byte-level tokenizer per worker; special strings in a text are ordinary text to it."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _tokenizers[path] = made
    return _tokenizers[path]


@bytewords.tidy
def encode_turns(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Escaped role and text of each turn with their ids."""
    made = tokenizer(path)
    for batch in batches:
        roles = [escape(x or "", True) for x in batch.column("role").to_pylist()]
        texts = [escape(x or "") for x in batch.column("text").to_pylist()]
        ids = lambda parts: pa.array([x.ids for x in made.encode_batch_fast(parts, add_special_tokens=False)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([
            batch.column("conv_id"), batch.column("turn"), batch.column("learnt"), pa.array(roles, pa.string()), pa.array(texts, pa.string()),
            ids(roles), ids(texts),
        ], names=["conv_id", "turn", "learnt", "role", "text", "role_ids", "text_ids"])


def assemble(turns: Column, reserved: int) -> Column:
    """Ids, text and the learnt spans [begin, end) of ordered turns; spans come from prefix sums of segment lengths."""
    spliced = F.flatten(F.transform(turns, lambda t: F.concat(
        F.array(F.lit(reserved)), t["role_ids"], F.array(F.lit(reserved + 1)), t["text_ids"], F.array(F.lit(reserved + 2))
    )))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int,learnt:boolean>>").alias("spans"))

    def add(a, t):
        begin = a["at"] + F.size(t["role_ids"]) + 2
        end = begin + F.size(t["text_ids"])
        return F.struct((end + 1).alias("at"), F.concat(a["spans"], F.array(F.struct(
            begin.alias("begin"), end.alias("end"), t["learnt"].alias("learnt")
        ))).alias("spans"))

    spans = F.aggregate(turns, start, add, lambda a: F.transform(
        F.filter(a["spans"], lambda s: s["learnt"]), lambda s: F.struct(s["begin"], s["end"])
    ))
    text = F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE)
    )), "")
    return F.struct(F.size(turns).cast("long").alias("n_turns"), spliced.alias("ids"), spans.alias("loss_spans"), text.alias("formatted"))


def format_chats(turns: DataFrame, vocabulary: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learnt: str = LEARNT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, ids, loss_spans, formatted.

    Turns are encoded where they are and meet once, as a conversation is one output row; it has to
    fit a task, as it has to fit a model.
    """
    send_package(turns.sparkSession)
    made = tokenizer(vocabulary)
    types = dict(turns.dtypes)
    plain = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role) == learnt, F.lit(False)).alias("learnt"),
        F.col(role).alias("role"), F.col(text).alias("text"),
    )
    coded = plain.mapInArrow(partial(encode_turns, vocabulary), (
        f"conv_id {types[conv_id]}, turn {types[turn]}, learnt boolean, role string, text string, role_ids array<int>, text_ids array<int>"
    ))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "learnt", "role_ids", "text_ids")))
    return coded.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.inline(F.array(assemble(F.col("turns"), made.get_vocab_size())))
    )


def loss_mask(ids: Column, spans: Column) -> Column:
    """The mask as one 0 or 1 per id."""
    place = F.sequence(F.lit(0), F.size(ids) - 1)
    return F.when(F.size(ids) > 0, F.transform(place, lambda i: F.exists(spans, lambda s: (s["begin"] <= i) & (i < s["end"])).cast("int")))


def read_turns(ids: np.ndarray, reserved: int, decode) -> list[tuple[str, str]]:
    """Role and text of each turn, from ids alone."""
    marks = np.flatnonzero(ids >= reserved)
    if len(marks) % 3 or not np.array_equal(ids[marks] - reserved, np.tile([0, 1, 2], len(marks) // 3)):
        raise ValueError("the reserved ids are not those of whole turns")
    parts = decode([ids[a + 1:b].tolist() for a, b in zip(marks[:-1], marks[1:])])
    return [(unescape(parts[k]), unescape(parts[k + 1])) for k in range(0, len(parts), 3)]


@bytewords.tidy
def digest_chats(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the output says: digests of all turns and of the text under the mask."""
    made = tokenizer(path)
    decode = partial(made.decode_batch, skip_special_tokens=False)
    reserved = made.get_vocab_size()
    for batch in batches:
        out = []
        for ids, spans, formatted in zip(batch.column("ids"), batch.column("loss_spans").to_pylist(), batch.column("formatted").to_pylist()):
            ids = ids.values.to_numpy()
            turns = read_turns(ids, reserved, decode)
            learnt = "".join(map(unescape, decode([ids[s["begin"]:s["end"]].tolist() for s in spans])))
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(pa.array, columns, kinds)], names=[
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_chats(chats: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of formatted conversations, read back from their ids, spans and text."""
    send_package(chats.sparkSession)
    return chats.select("conv_id", "ids", "loss_spans", "formatted").mapInArrow(partial(digest_chats, vocabulary), (
        f"conv_id {dict(chats.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ))


def parse_formatted(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn from the formatted text alone."""
    escaped = r"\\(?:\\|###|</turn>|:)"
    role, text = rf"((?:{escaped}|(?!###|</turn>)[^\\:])*)", rf"((?:{escaped}|(?!###|</turn>)[^\\])*)"
    turn = re.compile(rf"### {role}: {text} </turn>\n")
    found, at = [], 0
    while at < len(formatted):
        match = turn.match(formatted, at)
        if not match:
            raise ValueError("not a formatted conversation")
        found.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return found
