"""Vectorised byte and word hashing shared by the text operators.

Every function works on whole texts held as one numpy byte array; nothing here
is limited to a prefix.  Hashes are 64-bit, depend on a seed, and are the same
on every machine.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Bytes of text that one vectorised step handles at most (a longer text is a step of its own).
STEP_BYTES = 1 << 19
#: Spans of more bytes are hashed one by one.
_LONG = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place of data as a little-endian word; zeros follow the end."""
    room = np.zeros(len(data) + 8, dtype=np.uint8)
    room[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=room.data, strides=(1,))


def span_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end) of bytes whose eights() are given.

    Eight bytes at a time are mixed into a state that starts from the length,
    so spans of one length of at most eight bytes never share a hash.
    """
    size = (end - start).astype(np.int64)
    out = mix64(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    at, left, live = np.asarray(start, dtype=np.int64), size, np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = at[live], left[live]
    every = len(live) == len(out)
    while len(live):
        word = words[at] & _MASK[np.minimum(left, 8)]
        if every:
            out = mix64(out ^ word)
        else:
            out[live] = mix64(out[live] ^ word)
        go = np.flatnonzero(left > 8)
        live, at, left, every = live[go], at[go] + 8, left[go] - 8, False
    long = np.flatnonzero(size > _LONG)
    if len(long):
        raw = np.ndarray(len(words) + 7, dtype=np.uint8, buffer=words.base if words.base is not None else words.data)
        for k in long:
            digest = hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
            out[k] = int.from_bytes(digest.digest(), "little")
    return out


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true places; a run never crosses a text's border."""
    if not len(inside):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[first] = inside[first]
    starts = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    edge[last] = inside[last]
    return starts, np.flatnonzero(edge) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space."""
    return runs_of(~_SPACE[data], offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as (all bytes, n+1 offsets); nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges [i, j) of rows whose texts together have at most `limit` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive texts: hashes of all their words in order, and each text's n+1 word offsets.

    A-Z is lower-cased.  A word never crosses a text's border.
    """
    starts, ends = word_spans(data, offsets)
    return span_hash(eights(_LOWER[data]), starts, ends, seed), np.searchsorted(starts, offsets)


#: Weights of the words of a shingle, by place.
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * U(0xA24BAED4963EE407)) | U(1)


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word shingles, text by text, and each text's n+1 shingle offsets.

    A text with fewer words has the whole sequence as its one shingle; one without words has none.
    """
    n_words = np.diff(offsets)
    n = len(n_words)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(n), counts)
    first = np.arange(at[-1]) - at[text] + offsets[text]
    if (n_words >= size).all():
        out = np.zeros(at[-1], dtype=np.uint64)
        for k in range(size):
            out += hashes[first + k] * _PLACE[k]
        return mix64(out + U(size)), at
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    out = np.zeros(at[-1], dtype=np.uint64)
    length = np.minimum(n_words, size)[text]
    for k in range(size):
        out += np.where(k < length, padded[first + k] * _PLACE[k], U(0))
    return mix64(out + length.astype(np.uint64)), at


def unique_per_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and the n+1 offsets."""
    parts, counts = [], [0]
    for i in range(len(offsets) - 1):
        x = np.sort(values[offsets[i] : offsets[i + 1]])
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        parts.append(x)
        counts.append(len(x))
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(counts)
