"""Chat formatting: whole conversations rendered, encoded once with offsets, and masked by binary search.

A turn is rendered as

    <|turn|>ROLE<|says|>TEXT<|end|>

and the three marks are control tokens, added to the vocabulary of a byte-level
tokenizer.  Roles and texts are escaped, so no mark can be written by a text:
`<|` becomes `<\\|`, and what already looks like an escape gets one more
backslash.  Marks split the input of the tokenizer, so a token never crosses
the border of a turn, and the spans of assistant texts meet the sorted token
offsets by two binary searches each.

Order of turns: turn, then role, then text, nulls first; repeated rows stay.
A null role or text is the empty text; rows of a null conv_id are one
conversation.  Only conv_id, turn, role and text are read.

A conversation of up to PART characters is one row.  A longer one comes in
parts, cut between turns, whose number rises with their order: its rows are
dealt by range over (conv_id, turn), so a conversation that holds most of the
table is rendered by many tasks.  A single turn is never cut.  As marks are
token borders, the ids of the parts in order are the ids of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, worker_held
from .align import byte_level

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
MARKS = (TURN, SAYS, END)
#: Characters of a conversation above which it is rendered in parts.
PART = 1 << 20
#: Characters that are encoded in one call.
CALL = 1 << 20
SCHEMA = "conv_id long, part long, text string, ids array<int>, loss array<boolean>"
_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

_MARKLIKE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _MARKLIKE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(text)]


class ChatTokenizer:
    """A byte-level vocabulary file with the marks as control tokens, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens(list(MARKS))
        self.bytes = byte_level(self.tokenizer)
        self.marks = np.array([self.tokenizer.token_to_id(m) for m in MARKS])

    def encode(self, texts: list[str]):
        """(ids, starts, ends) of each text: offsets in code points, ascending."""
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            yield np.array(e.ids, dtype=np.int32), at[:, 0], at[:, 1]


def span_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (sorted offsets) share a character with one of the sorted, disjoint spans."""
    step = np.zeros(len(starts) + 1, dtype=np.int32)
    if spans:
        low, high = np.array(spans, dtype=np.int64).T
        first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high, side="left")
        some = first < last
        np.add.at(step, first[some], 1)
        np.add.at(step, last[some], -1)
    return np.cumsum(step[:-1]) > 0


def _tokenizer(path: str) -> ChatTokenizer:
    return worker_held(("chat", path), lambda: ChatTokenizer(path))


def _rendered(path: str, role_learnt: str, long: bool):
    """Sorted turns -> rows of SCHEMA."""

    @lean
    def run(batches):
        tokenizer = _tokenizer(path)
        base = (TaskContext.get().partitionId() << 32) if long else 0
        ready, size = [], 0  # (conv_id, part, text, spans)

        def out():
            nonlocal ready, size
            if ready:
                ids, loss = [], []
                for (_, _, _, spans), (i, s, e) in zip(ready, tokenizer.encode([x[2] for x in ready])):
                    ids.append(i)
                    loss.append(span_mask(s, e, spans))
                at = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(v))) for v in (ids, loss)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ready], pa.int64()), pa.array([x[1] for x in ready], pa.int64()), pa.array([x[2] for x in ready], pa.string()), *lists], schema=_OUT)
            ready, size = [], 0

        conv, part, pieces, spans, place = None, 0, [], [], 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if pieces and (c != conv or place >= PART and long):
                    ready.append((conv, base + part, "".join(pieces), spans))
                    part = part + 1 if c == conv else 0
                    size, pieces, spans, place = size + place, [], [], 0
                    if size >= CALL:
                        yield from out()
                conv = c
                head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
                start = place + len(head)
                if role == role_learnt and body:
                    spans.append((start, start + len(body)))
                pieces += (head, body, END)
                place = start + len(body) + len(END)
        if pieces:
            ready.append((conv, base + part, "".join(pieces), spans))
        yield from out()

    return run


def _parts(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Turns of conversations up to PART characters, whole and sorted in a task; the other turns dealt by range, or None."""
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    size = F.sum(F.char_length("role") + F.char_length("text") + sum(map(len, MARKS)))
    long = rows.groupBy("conv_id").agg(size.alias("_size")).where(F.col("_size") > PART).select(F.col("conv_id").alias("_long"))
    if long.isEmpty():
        return rows.repartition("conv_id").sortWithinPartitions(*order), None
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = rows.join(long, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
    return short, rows.join(long, same, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)


def format_conversations(turns: DataFrame, path: str, learn: str = "assistant") -> DataFrame:
    """(conv_id, part, text, ids, loss) of turns(conv_id, turn, role, text): rendered text, ids of the vocabulary file at
    `path` with the marks added, and whether each id bears loss: those of the texts of the role `learn`, whole and alone.
    See above for order, nulls, escapes and parts; an empty table gives none."""
    short, long = _parts(turns)
    out = short.mapInArrow(_rendered(path, learn, False), SCHEMA)
    return out if long is None else out.union(long.mapInArrow(_rendered(path, learn, True), SCHEMA))


def _digested(path: str):
    """Rows of SCHEMA, parts of a conversation in order -> rows of DIGEST, read from the output alone."""

    @lean
    def run(batches):
        tokenizer, state, done = _tokenizer(path), None, []

        def close():
            conv, n, turns, chars, loss, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _DIGEST.types)], schema=_DIGEST)
            done.clear()

        for batch in batches:
            for conv, text, ids, loss in zip(*(batch.column(k) for k in ("conv_id", "text", "ids", "loss"))):
                conv, text = conv.as_py(), text.as_py()
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                mask = np.concatenate([[False], loss.values.to_numpy(zero_copy_only=False), [False]])
                edge = np.flatnonzero(mask[1:] != mask[:-1])
                for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):  # a run of ids that bear loss is one text
                    learnt = unescape(b"".join(tokenizer.bytes[k] for k in ids.values[i:j].to_pylist()).decode())
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if done:
                yield from flush()
        if state is not None:
            close()
            yield from flush()

    return run


def digests(turns: DataFrame, path: str, learn: str = "assistant") -> DataFrame:
    """What can be read back from format_conversations(): turns from the text, learnt texts from the ids under the mask.

    A digest runs over a conversation in order, so the parts of a long one meet
    in one task, which streams over them.
    """
    short, long = _parts(turns)
    out = short.mapInArrow(_rendered(path, learn, False), SCHEMA).mapInArrow(_digested(path), DIGEST)
    if long is None:
        return out
    parts = long.mapInArrow(_rendered(path, learn, True), SCHEMA).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return out.union(parts.mapInArrow(_digested(path), DIGEST))
