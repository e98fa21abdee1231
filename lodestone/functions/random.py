"""The seeded 32-bit permuted congruential generator and its operator streams, vectorised over rows.

A Streams object holds one generator per row; every draw advances the chosen
rows alone, so rows with rejections stay independent of each other.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# Multiplier, increment, and the tags of stream derivation.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
GENERATION_TAG, POPULATION_TAG, DOMAIN_TAG = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x94D049BB133111EB
STATE_TAG, STREAM_TAG = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
SELECTION, CROSSOVER, MUTATION = 2, 3, 4
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype=np.uint64)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def schedule(material: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and increment of the stream derived from this material."""
    material = mix64(material)
    turned = (material << U(23)) | (material >> U(41))
    return mix64(material ^ U(STATE_TAG)), (mix64(turned ^ U(STREAM_TAG)) << U(1)) | U(1)


class Streams:
    def __init__(self, state: np.ndarray, increment: np.ndarray):
        self.state, self.increment = np.array(state, dtype=np.uint64), np.array(increment, dtype=np.uint64)

    @classmethod
    def seeded(cls, seeds) -> Streams:
        seeds = np.array([int(s) & _M64 for s in seeds], dtype=np.uint64)
        out = cls(np.zeros(len(seeds), dtype=np.uint64), np.full(len(seeds), INCREMENT, dtype=np.uint64))
        every = np.arange(len(seeds))
        out.word(every)
        out.state += seeds
        out.word(every)
        return out

    @classmethod
    def derived(cls, seed: int, generation, index, domain: int) -> Streams:
        """One stream for each (generation, index) of an operator's domain; no warm-up step."""
        index = np.asarray(index).astype(np.uint64)
        generation = np.broadcast_to(np.asarray(generation).astype(np.uint64), index.shape)
        return cls(*schedule(U(seed & _M64) ^ mix64(generation ^ U(GENERATION_TAG)) ^ mix64(index ^ U(POPULATION_TAG)) ^ mix64(np.full(index.shape, domain ^ DOMAIN_TAG, dtype=np.uint64))))

    def word(self, rows: np.ndarray) -> np.ndarray:
        """The next 32-bit word of the chosen rows."""
        old = self.state[rows]
        self.state[rows] = old * U(MULTIPLIER) + self.increment[rows]
        x = (((old >> U(18)) ^ old) >> U(27)) & U(0xFFFFFFFF)
        r = old >> U(59)
        return ((x >> r) | (x << ((U(32) - r) & U(31)))) & U(0xFFFFFFFF)

    def uniform(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Unbiased whole numbers below bound; a rejected row draws again."""
        bound = np.broadcast_to(np.asarray(bound).astype(np.uint64), rows.shape)
        least = (U(0) - bound) % bound
        out, todo = np.zeros(len(rows), dtype=np.uint64), np.arange(len(rows))
        while len(todo):
            low = self.word(rows[todo])
            sample = low | (self.word(rows[todo]) << U(32))
            ok = sample >= least[todo]
            out[todo[ok]] = sample[ok] % bound[todo[ok]]
            todo = todo[~ok]
        return out

    def event(self, rows: np.ndarray, probability: float) -> np.ndarray:
        """True with the probability; always takes one word."""
        return self.word(rows) < U(int(probability * 4294967296.0))


def jump(state: int, increment: int, steps: int) -> int:
    """The state after so many steps, in log(steps) multiplications."""
    mul, add, m, c = 1, 0, MULTIPLIER, increment
    while steps:
        if steps & 1:
            mul, add = mul * m & _M64, (add * m + c) & _M64
        m, c = m * m & _M64, (m + 1) * c & _M64
        steps >>= 1
    return (state * mul + add) & _M64


def filled_rows(seed: int, first: np.ndarray, size: int) -> list[bytes]:
    """Rows `first` of one continuous byte fill of a slab of rows of `size` bytes: any rows, in any order."""
    start = Streams.seeded([seed])
    state, increment = int(start.state[0]), int(start.increment[0])
    begin = np.asarray(first, dtype=np.int64) * size
    words = (size + 3) // 4 + 1
    rows = Streams(np.array([jump(state, increment, int(b) // 4) for b in begin], dtype=np.uint64), np.full(len(begin), increment, dtype=np.uint64))
    every = np.arange(len(begin))
    table = np.stack([rows.word(every).astype("<u4") for _ in range(words)], axis=1)
    return [table[i].tobytes()[b % 4 : b % 4 + size] for i, b in enumerate(begin)]
