"""Quality of derived random streams: collisions, avalanche and relations between domains; schedules are made from Arrow batches.

A tuple (seed, generation, population_index, domain) gives the starting state
and the increment of a generator; 64-bit words are longs with the same bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.functions import random as r
from lodestone.functions import u64

#: Bits of a bucket of the histogram of changed bits, and the number of the last bucket (128 bits in all).
BUCKET, LAST = 8, 16


def _unsigned(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bits of a whole-number column, and where it is null."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), column.is_null().to_numpy(zero_copy_only=False)


def _material(batch: pa.RecordBatch, seed: str, domain: str) -> tuple[np.ndarray, np.ndarray]:
    """What a tuple's schedule is made from, and where a part of the tuple is null."""
    out, lost = _unsigned(batch.column(seed))
    for name, tag in (("generation", r.GENERATION_TAG), ("population_index", r.POPULATION_TAG), (domain, r.DOMAIN_TAG)):
        part, null = _unsigned(batch.column(name))
        out, lost = out ^ r.mix64(part ^ np.uint64(tag)), lost | null
    return out, lost


def with_schedule(df: DataFrame, seed: str, domain: str, state: str, increment: str) -> DataFrame:
    """Adds the state and increment of each tuple's stream (null if a part is); generation and population_index are columns of those names."""

    def run(batches):
        for batch in batches:
            material, lost = _material(batch, seed, domain)
            words = [pa.array(x.view(np.int64), mask=lost) for x in r.schedule(material)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *words], names=[*batch.schema.names, state, increment])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(state, LongType()), StructField(increment, LongType())]))


def first_word(state: Column) -> Column:
    """The first 32-bit word that a stream in this state gives."""

    def word(s):
        low = F.lit(0xFFFFFFFF).cast("long")
        x = F.shiftrightunsigned(F.shiftrightunsigned(s, 18).bitwiseXOR(s), 27).bitwiseAND(low)
        turn = F.shiftrightunsigned(s, 59).cast("int")
        right, left = F.call_function("shiftrightunsigned", x, turn), F.call_function("shiftleft", x, (32 - turn).bitwiseAND(F.lit(31)))
        return right.bitwiseOR(left).bitwiseAND(low)

    return u64.let(state, word)


def collisions(tuples: DataFrame, group: str) -> DataFrame:
    """(group, tuples, collisions): tuples beyond the first of each (state, increment).  tuples(group, seed, generation,
    population_index, domain); equal schedules are counted before they meet."""
    rows = with_schedule(tuples, "seed", "domain", "_state", "_increment")
    each = rows.groupBy(group, "_state", "_increment").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(group).agg(F.sum("_n").alias("tuples"), F.sum(F.col("_n") - 1).alias("collisions"))


def _changed() -> Column:
    return (F.bit_count(F.col("_a").bitwiseXOR(F.col("_c"))) + F.bit_count(F.col("_b").bitwiseXOR(F.col("_d")))).cast("long")


def avalanche(tuples: DataFrame) -> DataFrame:
    """(bucket, pairs, changed_bits): how many of the 128 bits of a schedule change when one bit of the seed is flipped,
    for every tuple and each of its 64 bits, in buckets of 8."""

    def run(batches):
        seen, lost = np.zeros(129, dtype=np.int64), 0
        for batch in batches:
            material, null = _material(batch, "seed", "domain")
            material, lost = material[~null], lost + 64 * int(null.sum())
            one = r.schedule(material)
            for bit in range(64):
                two = r.schedule(material ^ np.uint64(1 << bit))
                seen += np.bincount(sum(np.bitwise_count(a ^ b) for a, b in zip(one, two)), minlength=129)
        rows = [(k, int(n)) for k, n in [*enumerate(seen), (None, lost)] if n]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], names=["changed", "n"])

    # A flipped bit of the seed is that bit of the material; a task returns a row for each number of changed bits.
    changed = tuples.select("seed", "generation", "population_index", "domain").mapInArrow(run, "changed long, n long")
    bucket = F.least(F.floor(F.col("changed") / BUCKET), F.lit(LAST)).cast("long").alias("bucket")
    return changed.groupBy(bucket).agg(F.sum("n").alias("pairs"), F.sum(F.col("changed") * F.col("n")).alias("changed_bits"))


def domain_relation(tuples: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(left_domain, right_domain, pairs, changed_bits, correlation) of the same tuples in two domains: changed bits of
    the schedules, and Pearson's correlation of their first words, 1 where one of them never varies."""
    sides = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("left_domain"), F.lit(y).cast("long").alias("right_domain")) for x, y in pairs])).alias("p")
    rows = tuples.select("seed", "generation", "population_index", sides).select("seed", "generation", "population_index", "p.*")
    rows = with_schedule(with_schedule(rows, "seed", "left_domain", "_a", "_b"), "seed", "right_domain", "_c", "_d")
    rows = rows.select("left_domain", "right_domain", _changed().alias("changed"), first_word(F.col("_a")).cast("double").alias("x"), first_word(F.col("_c")).cast("double").alias("y"))
    still = (F.stddev_pop("x") == 0) | (F.stddev_pop("y") == 0)
    correlation = F.when(still, 1.0).otherwise(F.corr("x", "y"))
    return rows.groupBy("left_domain", "right_domain").agg(F.count(F.lit(1)).alias("pairs"), F.sum("changed").alias("changed_bits"), correlation.alias("correlation"))
