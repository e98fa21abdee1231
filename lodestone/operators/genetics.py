"""Selection draws, crossover and mutation over byte genomes, row by row from derived streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.random import CROSSOVER, MUTATION, SELECTION, Streams

from .ranking import meet_in_buckets

CROSSOVERS = ("clone", "one-point", "two-point", "uniform")


def crossover_places(streams: Streams, rows: np.ndarray, size: int, kind: str) -> np.ndarray:
    """(rows, size) of the places whose bytes the parents swap."""
    at = np.arange(size)
    if kind == "clone" or (kind == "one-point" and size < 2):
        return np.zeros((len(rows), size), dtype=bool)
    if kind == "one-point":
        cut = 1 + streams.uniform(rows, size - 1).astype(np.int64)
        return at[None] >= cut[:, None]
    if kind == "two-point":
        first = streams.uniform(rows, size + 1).astype(np.int64)
        second = streams.uniform(rows, size).astype(np.int64)
        second += second >= first
        low, high = np.minimum(first, second), np.maximum(first, second)
        return (at[None] >= low[:, None]) & (at[None] < high[:, None])
    words = np.stack([streams.word(rows) for _ in range(-(-size // 32))], axis=1)
    return (words[:, at // 32] >> (at % 32).astype(np.uint64)[None]) & np.uint64(1) == 1


def cross(a: np.ndarray, b: np.ndarray, streams: Streams, rate: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Children of parents (rows, size); the rate's event always takes a word, a miss clones both."""
    every = np.arange(len(a))
    hit = every[streams.event(every, rate)]
    swap = np.zeros(a.shape, dtype=bool)
    if len(hit):
        swap[hit] = crossover_places(streams, hit, a.shape[1], kind)
    return np.where(swap, b, a), np.where(swap, a, b)


def mutate(genomes: np.ndarray, streams: Streams, rate: float) -> np.ndarray:
    """At the rate's event one byte is combined by exclusive or with a mask that is never zero."""
    every = np.arange(len(genomes))
    hit = every[streams.event(every, rate)]
    out = genomes.copy()
    if len(hit):
        place = streams.uniform(hit, genomes.shape[1]).astype(np.int64)
        mask = 1 + streams.uniform(hit, 255).astype(np.int64)
        out[hit, place] ^= mask.astype(np.uint8)
    return out


def parent_tickets(pairs: DataFrame, seed: int, generation: int, offspring: int, bound: int, draws: int = 1) -> DataFrame:
    """pairs(id): (pair, parent, draw, ticket): tickets below `bound` for both parents of each pair.

    The two parents draw one after the other from the pair's stream; each takes
    `draws` tickets (more than one for tournaments).  The last pair of an odd
    count has one parent.
    """

    def run(parts):
        for part in parts:
            pair = part["id"].to_numpy()
            streams, every = Streams.derived(seed, generation, pair, SELECTION), np.arange(len(part))
            out = []
            for parent in (0, 1):
                for draw in range(draws):
                    ticket = streams.uniform(every, bound).astype(np.int64)
                    keep = (2 * pair + parent) < offspring
                    out.append(pd.DataFrame({"pair": pair[keep], "parent": parent, "draw": draw, "ticket": ticket[keep]}))
            yield pd.concat(out)

    return pairs.mapInPandas(run, "pair long, parent int, draw int, ticket long")


def place_tickets(tickets: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds the index whose interval holds each ticket.

    intervals(population_index, ticket_from, ticket_to) are half-open and
    disjoint.  Tickets and intervals meet in buckets (ranking.meet_in_buckets),
    so any task may hold any part of a population.
    """
    one = F.lit(0).alias("_g")
    met = meet_in_buckets(intervals.select(one, "population_index", "ticket_from", "ticket_to"), tickets.select("*", one), "_g", "ticket")
    return met.select(*tickets.columns, "population_index")


def children(parents: DataFrame, seed: int, generation: int, offspring: int, crossover_rate: float, kind: str, mutation_rate: float) -> DataFrame:
    """parents(pair, a, b): the pair's two children (or its one), crossed and mutated: (population_index, genome)."""

    def run(parts):
        for part in parts:
            if not len(part):
                continue
            pair = part["pair"].to_numpy()
            both = part["b"].notna().to_numpy()
            a = np.array([np.frombuffer(x, dtype=np.uint8) for x in part["a"]])
            b = np.array([np.frombuffer(y if ok else x, dtype=np.uint8) for x, y, ok in zip(part["a"], part["b"], both)])
            if both.any():
                one, two = cross(a[both], b[both], Streams.derived(seed, generation, pair[both], CROSSOVER), crossover_rate, kind)
                a, b = a.copy(), b.copy()
                a[both], b[both] = one, two
            for slot, genomes, keep in ((2 * pair, a, np.ones(len(pair), dtype=bool)), (2 * pair + 1, b, both)):
                keep = keep & (slot < offspring)
                if keep.any():
                    out = mutate(genomes[keep], Streams.derived(seed, generation, slot[keep], MUTATION), mutation_rate)
                    yield pd.DataFrame({"population_index": slot[keep], "genome": [g.tobytes() for g in out]})

    return parents.mapInPandas(run, "population_index long, genome binary")
