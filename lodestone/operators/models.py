"""Small evaluators over four-byte genomes: each gives (valid, total) as expressions over four byte columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fixtures of the models.
REPOSITORY_SCORES = ((8, 6, 9, 7), (7, 9, 6, 8), (6, 8, 7, 9), (9, 7, 8, 6))
SCHEDULER_PRIORITIES = (9, 5, 8, 4, 7, 6)


def _over(x: Column, limit: int) -> Column:
    return F.greatest(x - limit, F.lit(0))


def repository_scoring(b: list[Column]) -> tuple[Column, Column]:
    w = [1 + F.pmod(x, F.lit(8)) for x in b]
    score = reduce(lambda a, c: a + c, [x * sum(s) for x, s in zip(w, REPOSITORY_SCORES)])
    return reduce(lambda a, c: a + c, w) <= 24, score - 50 * F.greatest(3 - w[3], F.lit(0))


def compiler_options(b: list[Column]) -> tuple[Column, Column]:
    o, u, i, v = (F.pmod(x, F.lit(n)) for x, n in zip(b, (4, 5, 4, 2)))
    valid = ~((o == 0) & (v == 1)) & ~((u == 4) & (i == 0))
    return valid, 1200 + 300 * o + 75 * u + 60 * i + 200 * v - 3 * _over(40 * u + 25 * i + 30 * v, 180)


def scheduler(b: list[Column]) -> tuple[Column, Column]:
    q, lanes, t = (1 + F.pmod(x, F.lit(8)) for x in b[:3])
    k = F.pmod(b[3], F.lit(5))
    total = 1600 + 180 * lanes + 95 * t + 40 * q + 3 * sum(SCHEDULER_PRIORITIES) - 20 * k - 90 * _over(t, 6)
    return (lanes <= t) & (q + k <= 10), total


def placement(b: list[Column]) -> tuple[Column, Column]:
    x, y, p, m = (F.pmod(v, F.lit(8)) for v in b)
    bonus = 300 - 20 * (F.abs(x - 4) + F.abs(y - 4))
    period, lut = 18 - p - F.floor(m / 2), 300 + 80 * p + 35 * m
    return (x + y <= 10) & (p <= 6) & (m < 12), 1100 + 220 * p + bonus + 60 * m - 120 * _over(period, 10) - 2 * _over(lut, 900)


MODELS = {"repository-scoring": repository_scoring, "compiler-options": compiler_options, "scheduler": scheduler, "placement": placement}
