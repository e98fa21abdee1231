"""Ordered 64-bit FNV-1a fingerprints, their text form, and CRC-32 with a blanked field."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OFFSET, PRIME = 14695981039346656037, 1099511628211
_M64 = (1 << 64) - 1


def fnv1a(data: bytes, value: int = OFFSET) -> int:
    for b in data:
        value = (value ^ b) * PRIME & _M64
    return value


def fnv1a_string(text: str, value: int = OFFSET) -> int:
    """Length (8 bytes, little-endian) first, then the bytes."""
    raw = text.encode()
    return fnv1a(raw, fnv1a(struct.pack("<Q", len(raw)), value))


def fnv1a_number(number: int, value: int = OFFSET) -> int:
    return fnv1a(struct.pack("<Q", number & _M64), value)


def text_form(value: int) -> str:
    return f"fnv1a64-v1:{value & _M64:016x}"


def fnv1a_many(rows: list[bytes]) -> list[int]:
    """fnv1a() of each row: all rows advance together, place by place, while several are left."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    data, sizes = np.frombuffer(b"".join(rows), dtype=np.uint8), sizes[order]
    state = np.full(len(rows), OFFSET, dtype=np.uint64)
    alone = int(sizes[15]) if len(sizes) > 15 else 0  # beyond this place fewer than 16 rows go on
    live = len(rows)
    for place in range(alone):
        while sizes[live - 1] <= place:
            live -= 1
        state[:live] = (state[:live] ^ data[starts[:live] + place]) * np.uint64(PRIME)
    out = [0] * len(rows)
    for k, i in enumerate(order.tolist()):
        out[i] = fnv1a(rows[i][alone:], int(state[k])) if sizes[k] > alone else int(state[k])
    return out


Summary = tuple[int, np.ndarray]  # of n bytes: a state h becomes h * PRIME**n + table[h mod 256], modulo 2**64
_LOW = np.arange(256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(PRIME, n, 1 << 64))


def compose(one: Summary, two: Summary) -> Summary:
    """The bytes of one, then those of two."""
    after = _LOW * _power(one[0]) + one[1]
    return one[0] + two[0], one[1] * _power(two[0]) + two[1][(after & np.uint64(255)).astype(np.intp)]


def applied(value: int, run: Summary) -> int:
    """The state after a run of bytes."""
    return (value * pow(PRIME, run[0], 1 << 64) + int(run[1][value & 255])) & _M64


def summary(data: bytes) -> Summary:
    """What a run of bytes does to any state: only a state's low byte meets a byte, so 256 starts are all there are.

    The run is cut into equal pieces that advance together, then composed.
    """
    pieces = min(256, max(1, len(data) // 64))
    width = len(data) // pieces
    block = np.frombuffer(data, dtype=np.uint8, count=pieces * width).reshape(pieces, width).T.astype(np.uint64)
    state = np.repeat(_LOW[None], pieces, axis=0)
    for column in block:
        state = (state ^ column[:, None]) * np.uint64(PRIME)
    tables = state - _LOW * _power(width)
    out = width, tables[0]
    for table in tables[1:]:
        out = compose(out, (width, table))
    rest = data[pieces * width :]
    return compose(out, summary(rest)) if rest else out


def _crc_zeros() -> list[list[int]]:
    """Matrices over two elements (columns as words) of 2**k zero bytes in CRC-32, k from 0."""
    one = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    out = [one]
    while len(out) < 64 + 3:
        m = out[-1]
        out.append([_crc_times(m, column) for column in m])
    return out[3:]


def _crc_times(matrix: list[int], vector: int) -> int:
    out = 0
    for k, column in enumerate(matrix):
        if vector >> k & 1:
            out ^= column
    return out


def crc32_combined(one: int, two: int, size: int) -> int:
    """CRC-32 of two payloads in a row from those of each; size: bytes of the second."""
    if not _ZEROS:
        _ZEROS.extend(_crc_zeros())
    for k, matrix in enumerate(_ZEROS):
        if size >> k & 1:
            one = _crc_times(matrix, one)
    return one ^ two


_ZEROS: list[list[int]] = []


@F.pandas_udf(StringType())
def fnv1a_text(values: pd.Series) -> pd.Series:
    """Fingerprint text of each string's (or binary's) bytes alone; null stays null."""
    there = values.notna()
    raw = [v.encode() if isinstance(v, str) else bytes(v) for v in values[there]]
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    out[there] = [text_form(x) for x in fnv1a_many(raw)]
    return out


@F.pandas_udf(StringType())
def fnv1a_record(values: pd.Series) -> pd.Series:
    """Fingerprint text of an array of strings, each with its length: field borders count."""

    def one(fields):
        value = OFFSET
        for f in fields:
            value = fnv1a_string(f, value)
        return text_form(value)

    return values.map(lambda v: None if v is None else one(v))


def fold_column(bytes_: Column) -> Column:
    """The same fingerprint by SQL functions alone: an unsigned long fold over an array of byte values."""
    from . import u64

    return F.aggregate(bytes_, u64.lit(OFFSET), lambda acc, b: u64.mul(acc.bitwiseXOR(b.cast("long")), PRIME))


def crc32_blanked(data: Column, first: int, size: int) -> Column:
    """CRC-32 of binary data whose bytes first..first+size-1 (from 0) count as zero."""
    blank = F.unhex(F.lit("00" * size))
    return F.crc32(F.concat(F.substring(data, 1, first), blank, F.substring(data, first + size + 1, 1 << 30)))
