"""Unsigned 64-bit arithmetic on long columns that hold the bit patterns.

Spark has no unsigned type and (in ANSI mode) long arithmetic that wraps is an
error, so sums go by 32-bit halves and products by 16-bit parts: no step leaves
the signed range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def signed(x: int) -> int:
    """The long with the bit pattern of an unsigned value."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def lit(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def _low(a: Column) -> Column:
    return a.bitwiseAND(F.lit(MASK32).cast("long"))


def _high(a: Column) -> Column:
    return F.shiftrightunsigned(a, 32)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a bound variable instead of a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add(a: Column, b: Column) -> Column:
    def both(x, y):
        low = _low(x) + _low(y)
        return F.shiftleft(_high(x) + _high(y) + _high(low), 32).bitwiseOR(_low(low))

    return let(a, lambda x: let(b, lambda y: both(x, y)))


def mul(a: Column, b: int) -> Column:
    """a times an unsigned constant, modulo 2**64."""
    b &= (1 << 64) - 1
    part = lambda x, k: x * F.lit((b >> 16 * k) & 0xFFFF).cast("long")  # noqa: E731  below 2**48 for x < 2**32
    low16 = lambda x: x.bitwiseAND(F.lit(0xFFFF).cast("long"))

    def product(x):
        low, high = _low(x), _high(x)
        # Of the cross terms only the low 32 bits count.
        cross = part(high, 0) + F.shiftleft(low16(part(high, 1)), 16) + part(low, 2) + F.shiftleft(low16(part(low, 3)), 16)
        return add(add(part(low, 0), F.shiftleft(part(low, 1), 16)), F.shiftleft(cross, 32))

    return let(a, product)


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def rotate_left(a: Column, k: int) -> Column:
    return F.shiftleft(a, k).bitwiseOR(F.shiftrightunsigned(a, 64 - k))


def mix64(a: Column) -> Column:
    """SplitMix64 finaliser."""
    a = mul(let(a, lambda x: xor(x, F.shiftrightunsigned(x, 30))), 0xBF58476D1CE4E5B9)
    a = mul(let(a, lambda x: xor(x, F.shiftrightunsigned(x, 27))), 0x94D049BB133111EB)
    return let(a, lambda x: xor(x, F.shiftrightunsigned(x, 31)))


def to_decimal(a: Column) -> Column:
    """The unsigned value as decimal(20,0)."""
    d = a.cast("decimal(20,0)")
    return F.when(a < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def less(a: Column, b: Column) -> Column:
    return xor(a, lit(1 << 63)) < xor(b, lit(1 << 63))


def hex16(a: Column) -> Column:
    return F.lower(F.lpad(F.hex(a), 16, "0"))
