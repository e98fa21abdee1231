"""Alignment of two tokenizers over the same bytes.

Every byte of a text gets a label: 0 no token ends there, 1 one of A does, 2 one
of B does, 3 both do.  A regular expression scans the label string for spans up
to each 3; the counts of labels in a span say how many tokens of either side
make the group.  The last tokens of a group's two sides are linked.

Texts of plain characters are split into units (white space and what follows it)
that neither tokenizer merges across; a worker aligns each unit once and
remembers it.  All other texts are one unit.  Linked tokens end at the same byte, so the shorter one is a
suffix of the longer: there are never more different pairs than the tokens of
both vocabularies have bytes, whatever the corpus, and the table of pair counts
(see `pair_counts`) may be broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, settle, texts, worker_held

#: Characters of text that are aligned in one go (a longer text is one go of its own); units and ids a worker remembers.
GO, CACHE, CACHE_IDS = 1 << 20, 400_000, 4_000_000
SCHEMA = "doc_id long, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>"
LINKS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_LINKS = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in LINKS.split(", ")])
_DIGEST = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST.split(", ")])

# Characters whose white space is that of both tokenizers' own rules.  A unit is white space and what follows it.
_OTHER = re.compile("[^\\t\\n\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f]")
_UNIT = re.compile("[\\t\\n ]*[^\\t\\n ]+|[\\t\\n ]+")
_SPAN = re.compile(b"[^3]*3")


def byte_level(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    words = (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))
    return [added[i] if i in added else bytes(back[c] for c in w) for i, w in enumerate(words)]


class _Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self):
        self.data, self.used = np.zeros(1 << 12, dtype=np.int32), 0
        self.sizes, self.starts = (np.zeros(0, dtype=np.int64) for _ in range(2))

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(self.used, len(values)), dtype=np.int32)])
        self.data[self.used : self.used + len(values)] = values
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(values)

    def take(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        at = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.starts[rows] - at, sizes) + np.arange(sizes.sum())]


class PairTokenizer:
    """A: a byte-level vocabulary file; B: a piece model that puts a space before the text and falls back to bytes.

    Neither merges across the start of a unit, so units are aligned once and
    remembered; `known` gives their rows in the arrays, -1 for a unit that its
    tokens do not give back.  When the memory is full, units used only once go.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = byte_level(self.a)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.line = len(self.b.encode("\n"))
        #: No piece of B goes on into white space, and none joins a line end to anything.
        self.by_unit = not any(re.search("[^▁\\t\\n ][▁\\t\\n ]|\n.", p, re.DOTALL) for p in names)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.uses = np.zeros(0, dtype=np.int64)
        self.ids_a, self.ids_b, self.groups_a, self.groups_b = (_Ragged() for _ in range(4))

    def _forget_rare(self) -> None:
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > CACHE // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: CACHE // 2]])
        new = np.full(len(self.uses), -1, dtype=np.int64)
        new[kept] = np.arange(len(kept))
        self.known = {u: n for u, i in self.known.items() if i >= 0 and (n := int(new[i])) >= 0}
        self.uses = self.uses[kept] // 2
        for name in ("ids_a", "ids_b", "groups_a", "groups_b"):
            old, held = getattr(self, name), _Ragged()
            held.add(old.take(kept), old.sizes[kept])
            setattr(self, name, held)

    def _encode(self, units: list[str], joined: bool):
        """Flat ids of each side, how many each unit has, and each unit's bytes; joined: the units may follow each other."""
        a, b = [], []
        for k in range(0, len(units), 5000):
            part = units[k : k + 5000]
            a += [e.ids for e in self.a.encode_batch_fast(["".join(part)] if joined else part, add_special_tokens=False)]
            # B puts a space before its input (but for an empty one); a unit that does not start so follows a line end, which is cut off again.
            spaced = [u[0] == " " and len(u) > 1 for u in part]
            two = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(part, spaced)], num_threads=1)
            b += [x if s else x[self.line :] for x, s in zip(two, spaced)]
        n_a, n_b = (np.fromiter(map(len, side), dtype=np.int64, count=len(side)) for side in (a, b))
        a, b = (list(chain.from_iterable(side)) for side in (a, b))
        return a, b, n_a, n_b, np.fromiter((len(u.encode()) for u in units), dtype=np.int64, count=len(units))

    def _learn(self, units: list[str], joined: bool) -> None:
        """Align units that are new: one label for each of their bytes, spans up to each byte where both sides end."""
        a, b, n_a, n_b, size = self._encode(units, joined)
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        ends = np.cumsum(size)
        if joined:
            n_a = np.diff(np.searchsorted(ends_a, ends, side="right"), prepend=0)
        same = all((np.concatenate([[0], e])[np.cumsum(n)] == ends).all() for e, n in ((ends_a, n_a), (ends_b, n_b)))
        if not (same and b"".join(map(self.bytes_a.__getitem__, a)) == "".join(units).encode() == b"".join(map(self.bytes_b.__getitem__, b))):
            if len(units) == 1:
                self.known[units[0]] = -1
            else:  # some unit is not given back: find it by halves
                self._learn(units[: len(units) // 2], joined)
                self._learn(units[len(units) // 2 :], joined)
            return
        self.known.update(zip(units, range(len(self.ids_a.sizes), len(self.ids_a.sizes) + len(units))))
        labels = np.full(ends[-1], ord("0"), dtype=np.uint8)
        labels[ends_a - 1] += 1
        labels[ends_b - 1] += 2
        spans = _SPAN.findall(labels.tobytes())
        counts = {s: (s.count(b"1") + 1, s.count(b"2") + 1) for s in set(spans)}
        sizes = np.array([counts[s] for s in spans], dtype=np.int64).reshape(-1, 2)
        groups = np.diff(np.searchsorted(np.cumsum(sizes[:, 0]), np.cumsum(n_a), side="right"), prepend=0)
        self.ids_a.add(ids_a, n_a)
        self.ids_b.add(ids_b, n_b)
        self.groups_a.add(sizes[:, 0], groups)
        self.groups_b.add(sizes[:, 1], groups)

    def align(self, batch: list[str]) -> tuple[np.ndarray, ...]:
        """(a, b, a_sizes, b_sizes, and for each text the number of a's, b's and groups); texts may be empty."""
        units, whole = [], []
        for t in batch:
            if self.by_unit and not _OTHER.search(t):
                units.append(_UNIT.findall(" " + t) if t else [])
            else:
                units.append([" " + t])
                whole.append(" " + t)
        every = list(chain.from_iterable(units))
        if len(self.known) > CACHE or self.ids_b.used > CACHE_IDS:
            self._forget_rare()
        rows = np.fromiter(map(self.known.get, every, repeat(-2)), dtype=np.int64, count=len(every))
        new = np.flatnonzero(rows == -2).tolist()
        if new:
            fresh, alone = {every[i] for i in new}, set(whole)
            alone |= {u for u in fresh if u[-1] in " \t\n"}  # white space without a word would run into the next unit's
            for some, joined in ((fresh - alone, True), (fresh & alone, False)):
                if some:
                    self._learn(list(some), joined)
            rows[new] = [self.known[every[i]] for i in new]
        uses = np.bincount(rows[rows >= 0], minlength=len(self.ids_a.sizes))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        for t in whole:
            self.known.pop(t, None)
        text = np.repeat(np.arange(len(batch)), [len(u) for u in units])
        bad = np.zeros(len(batch), dtype=bool)
        bad[text[rows < 0]] = True
        rows, text = rows[~bad[text]], text[~bad[text]]
        held = (self.ids_a, self.ids_b, self.groups_a)
        per_text = [np.bincount(text, h.sizes[rows], minlength=len(batch)).astype(np.int64) for h in held]
        return *(h.take(rows) for h in (*held, self.groups_b)), *per_text


def _pair(path_a: str, path_b: str) -> PairTokenizer:
    return worker_held(("pair", path_a, path_b), lambda: PairTokenizer(path_a, path_b))


def _list(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))


def _goes(batches, pair: PairTokenizer):
    """(doc_id, alignment) of bounded parts of the batches."""
    for batch in batches:
        size = np.cumsum(pc.coalesce(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = [*np.flatnonzero(np.diff(size // GO)) + 1, len(size)] if len(size) else []
        for i, j in zip([0, *cuts], cuts):
            part = batch.slice(i, j - i)
            yield part.column("doc_id"), pair.align([t or "" for t in part.column("text").to_pylist()])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b, a_sizes, b_sizes): ids of both tokenizers, and how many of each make up each group, in order.

    A encodes a space and the text, B the text, which it puts a space before;
    control strings in texts are plain text.  A text that is null or empty, or
    that the bytes of one side's tokens do not give back, has empty arrays.
    A row for each row, repeated and null ids too; other columns are not read.
    A very long text is aligned whole by one task.
    """

    @lean
    def run(batches):
        for ids, (a, b, sa, sb, n_a, n_b, groups) in _goes(batches, _pair(path_a, path_b)):
            yield pa.RecordBatch.from_arrays([ids, _list(a, n_a), _list(b, n_b), _list(sa, groups), _list(sb, groups)], names=["doc_id", "a", "b", "a_sizes", "b_sizes"])

    return texts(docs).mapInArrow(run, SCHEMA)


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of LINKS: counts of each document's alignment, its digest, and the linked ids as bytes (32 bits each)."""

    @lean
    def run(batches):
        numbers = None
        for ids, (a, b, sa, sb, n_a, n_b, groups) in _goes(batches, _pair(path_a, path_b)):
            top = int(max(a.max(initial=0), b.max(initial=0))) + 1
            if numbers is None or len(numbers[1]) < top:
                numbers = _number_texts(top)
            text, ends = group_texts(a, b, sa, sb, numbers)
            cut = np.concatenate([[0], np.cumsum(groups)])
            at = np.concatenate([[0], ends])[cut].tolist()
            shas = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:])]
            last = [_binary(x[np.cumsum(s) - 1], cut) for x, s in ((a, sa), (b, sb))]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups)], pa.array(shas, pa.string()), *last], schema=_LINKS)

    return texts(docs).mapInArrow(run, LINKS)


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """values[cut[i]:cut[i + 1]] as bytes, row by row."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((4 * cut).astype("<i4")), pa.py_buffer(values.astype("<i4"))])


def _linked(batch) -> np.ndarray:
    """A code (a, b) of each link of some rows of LINKS, in order."""
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<i4").astype(np.int64) for c in ("a", "b"))
    return a << 32 | b


def _slices(batches, rows: int = 1000):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, n): how many links hold each pair of ids.  Summed in each task first; its size is bounded by the vocabularies."""

    @lean
    def run(batches):
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for part in _slices(batches):
            new, n = np.unique(_linked(part), return_counts=True)
            codes, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(counts)], names=["a", "b", "n"])

    return linked.select("a", "b").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _number_texts(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..size-1, left-aligned, with a place to spare, and how many there are."""
    text = np.char.mod("%d", np.arange(size)).astype("S")
    width = text.dtype.itemsize
    out = np.zeros((size, width + 1), dtype=np.uint8)
    out[:, :width] = text.view(np.uint8).reshape(size, width)
    return out, np.char.str_len(text).astype(np.int64)


def group_texts(a, b, sa, sb, numbers) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups at once, and where the text of each group ends."""
    digits, length = numbers
    ends_a, ends_b = np.cumsum(sa), np.cumsum(sb)
    place_a = np.arange(len(a)) + np.repeat(ends_b - sb, sa)
    place_b = np.arange(len(b)) + np.repeat(ends_a, sb)
    ids, mark = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[ends_a - 1]], mark[place_b[ends_b - 1]] = ord("|"), ord(";")
    rows, n = digits[ids], length[ids]
    rows[np.arange(len(ids)), n] = mark
    ends = np.cumsum(n + 1)
    return rows[np.arange(rows.shape[1])[None] <= n[:, None]].tobytes(), ends[place_b[ends_b - 1]] if len(sb) else ends


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts and a digest of each document's alignment: see DIGEST.

    n_best: links whose pair count is the highest of all pairs of their B id,
    ties included; count_sum: pair counts over the links.  A document without
    tokens has zeros and an empty digest.
    """
    linked = settle(links(docs, path_a, path_b))
    table = pair_counts(linked).toArrow()  # bounded by the vocabularies: see the top
    codes = table["a"].to_numpy() << 32 | table["b"].to_numpy()
    order = np.argsort(codes)
    codes, counts = codes[order], table["n"].to_numpy()[order]
    best = np.zeros(int((codes & 0xFFFFFFFF).max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(best, codes & 0xFFFFFFFF, counts)
    shared = docs.sparkSession.sparkContext.broadcast((codes, counts, best))

    @lean
    def run(batches):
        codes, counts, best = shared.value
        for part in _slices(batches):
            found = _linked(part)
            cut = np.concatenate([[0], np.cumsum(part.column("n_groups").to_numpy(zero_copy_only=False))])
            n = counts[np.searchsorted(codes, found)]
            sums, hits = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n == best[found & 0xFFFFFFFF]))
            new = [pa.array(x[cut[1:]] - x[cut[:-1]], pa.int64()) for x in (hits, sums)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")), *new, part.column("groups_sha256")], schema=_DIGEST)

    return linked.mapInArrow(run, DIGEST)
