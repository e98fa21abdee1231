"""Pieces of DuckDB SQL: unsigned 64-bit steps, byte lists and fingerprints over them."""

from __future__ import annotations

from lodestone.functions import random as r

P64 = "18446744073709551616::UHUGEINT"


def mul(a: str, b: int | str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % {P64} AS UBIGINT)"


def add(a: str, b: int | str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {P64} AS UBIGINT)"


def shl(a: str, k: int | str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) << {k}) % {P64} AS UBIGINT)"


def number(x: str) -> str:
    """Eight bytes, little-endian, of a whole number that is not negative."""
    return f"list_transform(range(0, 8), lambda i: (CAST({x} AS BIGINT) >> (8 * CAST(i AS INTEGER))) & 255)"


def ascii_bytes(s: str) -> str:
    return f"list_transform(range(1, strlen({s}) + 1), lambda i: CAST(ascii(({s})[i]) AS BIGINT))"


def text(s: str) -> str:
    return f"list_concat({number(f'strlen({s})')}, {ascii_bytes(s)})"


def concat(*parts: str) -> str:
    return f"flatten([{', '.join(parts)}])"


def fnv_value(bytes_: str) -> str:
    """Fingerprint of a list of byte values, an unsigned number."""
    step = f"(CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211::UHUGEINT) % {P64}"
    folded = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform({bytes_}, lambda x: CAST(x AS UHUGEINT))), lambda h, b: {step})"
    return f"CAST({folded} AS UBIGINT)"


def fnv(bytes_: str) -> str:
    """Fingerprint text of a list of byte values."""
    return f"'fnv1a64-v1:' || printf('%016x', {fnv_value(bytes_)})"


def unsigned(x: str) -> str:
    """Eight bytes, little-endian, of an unsigned number."""
    return f"list_transform(range(0, 8), lambda i: CAST((CAST({x} AS UBIGINT) >> (8 * CAST(i AS INTEGER))) & 255 AS BIGINT))"


class Chain:
    """Nested SELECTs, each with one more column computed from those before it."""

    def __init__(self, source: str):
        self.source, self.columns, self.n = source, [], 0

    def let(self, expr: str, name: str | None = None) -> str:
        self.n += 1
        name = name or f"v{self.n}"
        self.columns.append(f"{expr} AS {name}")
        return name

    def sql(self) -> str:
        out = f"SELECT * FROM {self.source}"
        for column in self.columns:
            out = f"SELECT *, {column} FROM ({out})"
        return out

    def mix(self, x: str) -> str:
        a = self.let(mul(f"xor({x}, {x} >> 30)", 0xBF58476D1CE4E5B9))
        b = self.let(mul(f"xor({a}, {a} >> 27)", 0x94D049BB133111EB))
        return self.let(f"xor({b}, {b} >> 31)")

    def stream(self, seed: int, generation: int, index: str, domain: int) -> Stream:
        """The derived stream of an operator's domain for (generation, index)."""
        parts = [self.mix(self.let(f"xor(CAST({x} AS UBIGINT), {tag}::UBIGINT)")) for x, tag in ((generation, r.GENERATION_TAG), (index, r.POPULATION_TAG), (domain, r.DOMAIN_TAG))]
        m = self.let(f"CAST({seed} AS UBIGINT)")
        for p in parts:
            m = self.let(f"xor({m}, {p})")
        m = self.mix(m)
        state = self.mix(self.let(f"xor({m}, {r.STATE_TAG}::UBIGINT)"))
        turned = self.let(f"({shl(m, 23)} | ({m} >> 41))")
        return Stream(self, state, self.let(f"({shl(self.mix(self.let(f'xor({turned}, {r.STREAM_TAG}::UBIGINT)')), 1)} | 1::UBIGINT)"))


class Stream:
    def __init__(self, chain: Chain, state: str, increment: str):
        self.chain, self.state, self.increment = chain, state, increment

    def word(self) -> str:
        c, old = self.chain, self.state
        self.state = c.let(add(mul(old, r.MULTIPLIER), self.increment))
        x, turn = c.let(f"(xor({old} >> 18, {old}) >> 27) & 4294967295::UBIGINT"), c.let(f"{old} >> 59")
        return c.let(f"(({x} >> {turn}) | ({x} << ((32::UBIGINT - {turn}) & 31::UBIGINT))) & 4294967295::UBIGINT")

    def uniform(self, bound: int | str) -> str:
        """A draw below a bound so small that a rejection (chance below 2**-40) is left out."""
        low, high = self.word(), self.word()
        return self.chain.let(f"CAST(({low} + ({high} << 32)) % CAST({bound} AS UBIGINT) AS BIGINT)")

    def event(self, probability: float) -> str:
        return self.chain.let(f"{self.word()} < {int(probability * 4294967296.0)}::UBIGINT")
