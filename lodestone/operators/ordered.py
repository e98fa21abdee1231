"""Total orders of whole tables: ranges between sampled keys, and ranks by the sizes of the ranges before.

A window over a whole table, or over a group that holds most of it, is one task.
Here the rows fall into ranges of their key, ranges are worked on apart, and
what is carried from one to the next is one row for each range and group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range: a range then holds more than twice its share with a chance of about 1e-6.
SAMPLE = 48


def range_count(df: DataFrame) -> int:
    """Ranges that give every task of a shuffle one."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass
class Ranges:
    """Borders of ranges, ascending; a key is in the range numbered by how many borders are not above it."""

    borders: list
    column: Column

    def of(self, key: Column) -> Column:
        """The number of the range of a key, by binary search in the borders."""
        n = len(self.borders)
        steps = [1 << k for k in reversed(range(n.bit_length()))]
        if not steps:
            return F.lit(0)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(self.column, at + s - 1) <= key), at + s).otherwise(at))


def _key(columns: list[Column]) -> Column:
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])


def _as_spark_sorts(key) -> tuple:
    """Nulls come first, NaN after all numbers."""
    return tuple((v is not None, v != v, 0 if v is None or v != v else v) for v in key)


def ranges(df: DataFrame, columns: list[Column], count: int | None = None) -> Ranges:
    """Borders that cut df, ordered by the columns, into about `count` even ranges.

    One pass: keys fall into buckets by hash, and of each bucket the key with
    the smallest second hash is a sample.  The same rows always give the same
    borders.  Equal keys share a range.
    """
    count = count or range_count(df)
    if count == 1:
        return Ranges([], F.array())
    rows = df.select(_key(columns).alias("_k"))
    sampled = rows.groupBy(F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(SAMPLE * count)).alias("_b")).agg(F.min_by("_k", F.xxhash64("_k", F.lit(2))).alias("_k"))
    keys = sorted((r["_k"] for r in sampled.select("_k").collect()), key=_as_spark_sorts)  # as many as the sample
    picked = [keys[len(keys) * i // count] for i in range(1, count)] if keys else []
    borders = [k for i, k in enumerate(picked) if i == 0 or k != picked[i - 1]]
    kind = rows.schema["_k"].dataType
    return Ranges(borders, F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind)]) for b in borders]))


def total_rank(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """Adds the 0-based rank of each row in ascending order of the columns (ties: any order among themselves)."""
    cut = ranges(df, columns)
    keyed = df.withColumn("_range", cut.of(_key(columns)))
    sizes = dict(keyed.groupBy("_range").count().collect())  # one row for each range
    before, total = [], 0
    for r in range(len(cut.borders) + 1):
        before.append(total)
        total += sizes.get(r, 0)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*columns)) - 1
    return keyed.withColumn(name, within + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range"))).drop("_range")


def wide_groups(cut: Ranges, group: Column) -> Column:
    """Whether a row's group, the first column of the key, may lie in several ranges: only those with a border inside do."""
    groups = {b[0] for b in cut.borders}
    named = [g for g in groups if g is not None]
    out = group.isin(named) if named else F.lit(False)
    return F.coalesce(out, F.lit(False)) | (group.isNull() if None in groups else F.lit(False))
