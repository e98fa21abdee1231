"""Packing of documents into training sequences by vector bin packing.

Every piece has a demand vector (tokens, segments, loss-bearing tokens) and
every open sequence a vector of remaining capacity.  The next piece is the one
that fits and has the largest dot product of demand and remaining capacity,
both as shares of the limits, so pieces that use what is plentiful go first.
When nothing fits, a document is cut to fill the rest.  All tokens of a plain
document bear loss; instruction data state the share that does, and a limit on
loss-bearing tokens below the limit on tokens then mixes prompts and answers.

Each task packs its own rows with a bounded pool of open remainders; nothing is
shuffled.  The last sequence of a task, and one that a limit keeps from being
filled, is cut into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import lean, texts

#: Limits of one sequence.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 256, 4096
LIMITS = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)
END_ID = 2
#: Remainders that wait in a task at most.
POOL = 512
#: Pieces in a worker's token cache from which it starts anew (about 40 bytes each).
CACHE = 600_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

# Texts of these characters alone are split and cached by word; for them NFC is the identity and
# lower-casing goes character by character.  All others go through the tokenizer as a whole.
_OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa1-\\u0240]|\\u0130|<\\|")
_LETTER = "a-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u0240"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_PIECE = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")

# Classes of bytes: 0 white space, 1 letter, 2 digit, 3 other, 4 apostrophe or beyond ASCII.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[39] = 1, 2, 4, 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 0


class WordTokenizer:
    """ids of texts by the vocabulary file at `path`, as its own encode() gives them, with a cache of pieces.

    The piece rules above are those of one vocabulary.  They are tried on a
    probe; with a file that they do not fit, every text goes through the
    tokenizer as a whole.  The cache is a few arrays: sorted hashes of pieces,
    a second hash that is compared too, and where the ids of each are.
    """

    PROBE = "It's the 1st Élan: naïve_façade, 3.5% (WE'LL)!! don't... ab12cd ~ über x x x"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for pieces with spaces between them
        self.bare.normalizer = normalizers.Sequence([])
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), to_bytes])
        size = self.bare.get_vocab_size()
        self.ends = np.array([(self.bare.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget()
        self.by_word = True
        probes = [*self.PROBE.split(), self.PROBE]
        self.by_word = self.encode_batch(probes) == [self._whole(p) for p in probes]

    def _forget(self) -> None:
        self.hashes, self.twins = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has; the last id of each piece has the word-end mark."""
        split = [_PIECE.findall(u) for u in units]
        ids = np.array(self.bare.encode_batch_fast([" ".join([p for ps in split for p in ps])], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1 if len(ids) else []]).astype(np.int64)
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        if len(ends) == counts.sum() + 1 and ends[-1] == len(ids):
            return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        if len(units) == 1:
            return ids, np.array([len(ids)])
        parts = [self._learn([u]) for u in units]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _known(self, hashes: np.ndarray, twins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its place in the cache, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return place, (self.hashes[place] == hashes) & (self.twins[place] == twins)

    def _add(self, data, starts, ends, hashes, twins) -> None:
        """Learn the ids of pieces whose hashes (ascending) the cache does not have."""
        text = data.tobytes()
        ids, sizes = self._learn([text[i:j].decode() for i, j in zip(starts.tolist(), ends.tolist())])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), dtype="<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.twins = np.insert(self.hashes, place, hashes), np.insert(self.twins, place, twins)
        self.starts, self.sizes = np.insert(self.starts, place, at.astype(np.int32)), np.insert(self.sizes, place, sizes.astype(np.int32))

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of lower-cased texts; a word with an apostrophe or beyond ASCII is one unit, split when it is learnt."""
        first, last = B.word_spans(data, offsets)
        kind = _CLASS[data]
        whole = np.unique(np.searchsorted(first, np.flatnonzero(kind == 4), side="right") - 1)
        step = np.zeros(len(data) + 1, dtype=np.int8)
        step[first[whole]] += 1
        step[last[whole]] -= 1
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = 1
        edge = kind == 2
        edge[1:] |= kind[1:] != kind[:-1]
        edge &= kind > 0
        edge[first] = True
        starts = np.flatnonzero(edge)
        word = np.searchsorted(first, starts, side="right") - 1
        return starts, np.minimum(np.append(starts[1:], len(data)), last[word])

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = {k: self._whole(t) for k, t in enumerate(batch) if not self.by_word or _OTHER.search(t)}
        low = [b"" if k in whole else t.lower().encode() for k, t in enumerate(batch)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)
        data = np.frombuffer(b"".join(low), dtype=np.uint8)
        if not len(data):
            return [whole.get(k, b"") for k in range(len(batch))]
        starts, ends = self._units(data, offsets)
        words = B.eights(data)
        hashes, first, inverse = np.unique(B.span_hash(words, starts, ends), return_index=True, return_inverse=True)
        twins = B.span_hash(words, starts[first], ends[first], 1)
        place, found = self._known(hashes, twins)
        if not found.all():
            if len(self.hashes) > CACHE:
                self._forget()
                found[:] = False
            new = np.flatnonzero(~found)
            self._add(data, starts[first[new]], ends[first[new]], hashes[new], twins[new])
            place, _ = self._known(hashes, twins)
        size = self.sizes[place][inverse].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.starts[place][inverse] - at[:-1], size) + np.arange(at[-1])].tobytes()
        cut = (4 * at[np.searchsorted(starts, offsets)]).tolist()
        return [whole[k] if k in whole else ids[cut[k] : cut[k + 1]] for k in range(len(batch))]


def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker process (the code of a task is made anew for each)."""
    home = sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker"))
    held = home.__dict__.setdefault("tokenizers", {})
    if path not in held:
        held.clear()
        held[path] = WordTokenizer(path)
    return held[path]


class Packer:
    """Packs items (key, n_tokens, loss share) under three limits; emits (key, start, length, sequence, offset)."""

    def __init__(self, emit, first_sequence: int = 0, tokens=MAX_TOKENS, segments=MAX_SEGMENTS, loss=MAX_LOSS):
        self.emit, self.sequence = emit, first_sequence
        self.limit = np.array([tokens, segments, loss], dtype=np.float64)
        # The pool: its first `n` places are in use; a place that is taken is filled by the last one.
        self.n = 0
        self.keys: list = [None] * (POOL + 1)
        self.starts = [0] * (POOL + 1)
        self.shares = [1.0] * (POOL + 1)
        self.demand = np.zeros((POOL + 1, 3))

    def add(self, key, n_tokens: int, loss_share: float = 1.0) -> None:
        """One document of n_tokens, of which a share bears loss, evenly spread over it."""
        full, start = int(self.limit[0]), 0
        while n_tokens - start >= full and loss_share * full <= self.limit[2]:
            self.emit(key, start, full, self.sequence, 0)
            self.sequence += 1
            start += full
        self._wait(key, start, n_tokens - start, loss_share)
        while self.n >= POOL:
            self._pack_one()

    def _wait(self, key, start: int, length: int, loss_share: float) -> None:
        if length == 0:
            return
        n = self.n
        self.keys[n], self.starts[n], self.shares[n] = key, start, loss_share
        self.demand[n] = length, 1, loss_share * length
        self.n = n + 1

    def _take(self, i: int):
        taken = self.keys[i], self.starts[i], self.shares[i], self.demand[i].copy()
        self.n = last = self.n - 1
        self.keys[i], self.starts[i], self.shares[i] = self.keys[last], self.starts[last], self.shares[last]
        self.demand[i] = self.demand[last]
        return taken

    def _pack_one(self) -> None:
        room, chosen = self.limit.copy(), []
        while self.n:
            demand = self.demand[: self.n]
            score = demand @ (room / self.limit**2)
            score[(demand > room + 1e-9).any(axis=1)] = -1
            i = int(score.argmax())
            if score[i] >= 0:
                key, start, _, row = self._take(i)
                chosen.append((key, start, int(row[0])))
                room = room - row
                continue
            if room[1] < 1 or room[0] < 1:
                break
            i = int(demand[:, 0].argmax())
            share = self.shares[i]
            cut = int(min(room[0], demand[i, 0] - 1, (room[2] + 1e-9) // share if share else room[0]))
            if cut < 1:
                break
            key, start, share, row = self._take(i)
            chosen.append((key, start, cut))
            room = room - [cut, 1, share * cut]
            self._wait(key, start + cut, int(row[0]) - cut, share)
        self._close(chosen, full=room[0] < 1)

    def _close(self, chosen, full: bool) -> None:
        """A full sequence as it is; another one cut into power-of-two lengths."""
        total = sum(n for _, _, n in chosen)
        while chosen:
            size = total if full else 1 << (total.bit_length() - 1)
            offset = 0
            while offset < size:
                key, start, n = chosen.pop(0)
                k = min(n, size - offset)
                self.emit(key, start, k, self.sequence, offset)
                if k < n:
                    chosen.insert(0, (key, start + k, n - k))
                offset += k
            self.sequence += 1
            total -= size

    def finish(self) -> None:
        while self.n:
            self._pack_one()


def _pack_task(path: str, limits):
    @lean
    def run(batches):
        tokenizer = worker_tokenizer(path)
        rows: list[tuple] = []
        waiting: dict[int, tuple] = {}  # document -> its id, ids and tokens not yet placed

        def emit(key, start, length, sequence, offset):
            doc_id, ids, left = waiting[key]
            rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset))
            if left == length:
                del waiting[key]
            else:
                waiting[key] = (doc_id, ids, left - length)

        packer = Packer(emit, TaskContext.get().partitionId() << 36, *limits)
        end, number = np.array([END_ID], dtype="<u4").tobytes(), 0

        def flush():
            columns = zip(*rows) if rows else [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)
            rows.clear()
            return out

        for batch in batches:
            for i, j in B.steps(B.column_bytes(batch.column(1))[1]):
                part = batch.slice(i, j - i)
                ids_of = tokenizer.encode_batch([t or "" for t in part.column(1).to_pylist()])
                for doc_id, ids, share in zip(part.column(0).to_pylist(), ids_of, part.column(2).to_pylist()):
                    ids += end
                    waiting[number] = (doc_id, ids, len(ids) // 4)
                    packer.add(number, len(ids) // 4, share)
                    number += 1
            yield flush()
        packer.finish()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, loss_share: Column | None = None, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence, with the crc32 of its ids.

    loss_share: the share of a row's tokens that bear loss (all, unless stated;
    null counts as all, and it is held between 0 and 1).  limits: tokens,
    segments and loss-bearing tokens of one sequence.  A null or empty text is
    its end id alone.  Rows that repeat are packed each for itself; a null
    doc_id stays null.  Extra columns are ignored.  No rows give no rows.
    tokenizer_path must be readable on every executor.
    """
    share = F.lit(1.0) if loss_share is None else F.least(F.greatest(F.coalesce(loss_share.cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return texts(docs, share.alias("_loss_share")).mapInArrow(_pack_task(tokenizer_path, limits), SCHEMA)
