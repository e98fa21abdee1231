"""Validity, fitness evidence, generation statistics and diversity of populations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .ranking import finite

COMPONENTS = ("correctness", "performance", "memory_use", "reliability", "maintainability", "constraint_penalty", "total")


def hard_filter(df: DataFrame, valid: Column, evaluate: dict[str, Column]) -> DataFrame:
    """Adds valid and, for valid rows alone, the evaluated columns; an invalid row's payload is 0 and not evaluated."""
    out = df.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("evaluated", F.col("valid"))
    for name, expr in evaluate.items():
        out = out.withColumn(name, F.when(F.col("valid"), expr).otherwise(0.0))
    return out


def evidence_valid(values: list[Column], penalty: Column) -> Column:
    """All values finite and the penalty not negative."""
    out = penalty >= 0
    for v in values:
        out = out & finite(v)
    return F.coalesce(out, F.lit(False))


def rankable(valid: Column, evaluated: Column, values: list[Column], penalty: Column) -> Column:
    """A row that takes part in rankings: valid, evaluated, and with evidence that is valid."""
    return F.coalesce(valid & evaluated, F.lit(False)) & evidence_valid(values, penalty)


def completed_problems(df: DataFrame, generation: str, stated: DataFrame) -> DataFrame:
    """(generation, problem) of completed populations that break a rule, the first broken one each.

    df(generation, population_index, valid, evaluated and COMPONENTS) are the
    rows, stated(generation, population_size, valid_count, best_index) what a
    run recorded; best_index is null without a valid row.  Rules: the rows are
    as many as stated; an invalid row is not evaluated and all its components
    are 0; a valid row is rankable; valid rows and the best row are as stated.
    """
    parts = [F.col(c) for c in COMPONENTS]
    zero = parts[0] == 0
    for c in parts[1:]:
        zero = zero & (c == 0)
    blank = F.coalesce(~F.col("evaluated") & zero, F.lit(False))
    fine = rankable(F.col("valid"), F.col("evaluated"), parts, F.col("constraint_penalty"))
    best = F.max_by("population_index", F.when(fine, F.struct("total", -F.col("population_index"))))
    seen = df.groupBy(generation).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("valid") & ~blank).alias("_dirty"), F.count_if(F.col("valid") & ~fine).alias("_loose"), F.count_if("valid").alias("_valid"), best.alias("_best")
    )
    rows = stated.join(seen, generation, "left")
    problem = (
        F.when(F.coalesce("_n", F.lit(0)) != F.col("population_size"), "population-size")
        .when(F.col("_dirty") > 0, "invalid-row-payload")
        .when(F.col("_loose") > 0, "evidence")
        .when(F.col("_valid") != F.col("valid_count"), "valid-count")
        .when(~F.col("_best").eqNullSafe(F.col("best_index")), "best-index")
    )
    return rows.select(generation, problem.alias("problem")).where("problem is not null")


def statistics_differences(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, fields): the fields in which two records of the same generation's statistics differ, nulls being equal and
    numbers equal only to the last bit; a record without its counterpart differs in all.  Records that agree are left out."""
    names = [c for c in one.columns if c != key]
    right = two.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_right"))
    both = one.withColumn("_left", F.lit(True)).join(right, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    alone = F.col("_left").isNull() | F.col("_right").isNull()
    fields = F.filter(F.array(*[F.when(alone | ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return both.select(F.coalesce(key, "_key").alias(key), fields.alias("fields")).where(F.size("fields") > 0)


def ordered_sum(index: str, value: str, where: Column | None = None) -> Column:
    """Sum of doubles in index order: the same bits whatever the partitioning.

    One group's values are gathered; groups are populations, whose size a run's configuration bounds.
    """
    item = F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("x"))
    rows = F.array_sort(F.collect_list(F.when(where, item) if where is not None else item))
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["x"])


def generation_statistics(df: DataFrame, generation: str, index: str, total: str, valid: str, components: tuple[str, ...] = ()) -> DataFrame:
    """Counts, best row (ties to the smaller index), and the ordered sum and mean of the total over valid rows.

    components: more columns whose ordered sums over the valid rows are added as <name>_sum.
    """
    ok = F.col(valid)
    best = F.max_by(F.struct(F.col(total).alias("t"), F.col(index).alias("i")), F.when(ok, F.struct(F.col(total), -F.col(index))))
    out = df.groupBy(generation).agg(
        F.count(F.lit(1)).alias("population"),
        F.count_if(ok).alias("valid_count"),
        best.alias("_b"),
        ordered_sum(index, total, ok).alias("total_sum"),
        *[ordered_sum(index, c, ok).alias(f"{c}_sum") for c in components],
    )
    return out.select(
        generation, "population", "valid_count", (F.col("population") - F.col("valid_count")).alias("invalid_count"),
        F.col("_b.i").alias("best_index"), F.col("_b.t").alias("best_total"), "total_sum",
        F.when(F.col("valid_count") > 0, F.col("total_sum") / F.col("valid_count")).alias("mean_total"), *[f"{c}_sum" for c in components],
    )


def byte_diversity(df: DataFrame, group: str, genome: str) -> DataFrame:
    """Mean share of differing bytes over all pairs of a group, without making pairs.

    At a place with value counts c_v among n rows, C(n,2) - sum C(c_v,2) pairs
    differ, so counts of (group, place, byte) are all that is shuffled.  Genomes
    of a group have one length.  The numerator is a whole number, divided once.
    """
    bytes_ = df.select(group, F.explode(F.sequence(F.lit(1), F.octet_length(genome))).alias("place"), F.col(genome).alias("_genome"))
    counts = bytes_.select(group, "place", F.expr("substring(_genome, place, 1)").alias("byte")).groupBy(group, "place", "byte").agg(F.count(F.lit(1)).alias("c"))
    places = counts.groupBy(group, "place").agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) div 2")).alias("same"))
    out = places.groupBy(group).agg(F.max("n").alias("valid_count"), F.count(F.lit(1)).alias("size"), F.sum(F.expr("n * (n - 1) div 2 - same")).alias("mismatches"))
    pairs = F.expr("valid_count * (valid_count - 1) div 2")
    return out.select(group, "valid_count", pairs.alias("pair_count"), "mismatches", F.when(pairs > 0, F.col("mismatches") / (pairs * F.col("size"))).otherwise(0.0).alias("diversity"))


def pair_diversity(df: DataFrame, group: str, index: str, distance, budget: int, unit_work: int = 1, tile: int = 512) -> DataFrame:
    """Mean of distance(a, b) over all unordered pairs of a group: for distances that have no other form.

    distance takes the columns' aliases "a" and "b"; a has the smaller index.
    The work is quadratic in a group's size by definition: a group whose pairs,
    times unit_work, pass the budget is refused before any pair is made.

    The pairs of a group are a triangle of tiles.  Its rows fall into blocks of
    about `tile` rows by hash, blocks lo <= hi make a tile, and a tile is the
    key of the join: at most tile squared pairs are made in one place, and rows
    are repeated once for each block of their group.
    """
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    check_pair_budget(largest, unit_work, budget)
    blocks = F.ceil(F.col("_n") / tile)
    rows = df.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_block", F.pmod(F.xxhash64(index), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_other")
    tiles = rows.select("*", other).withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other")).drop("_other", "_n", "_group")
    a, b = tiles.alias("a"), tiles.alias("b")
    same = F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col("a._lo") == F.col("b._lo")) & (F.col("a._hi") == F.col("b._hi"))
    one_of_each = F.col("a._block") + F.col("b._block") == F.col("a._lo") + F.col("a._hi")
    pairs = a.join(b, same & one_of_each & (F.col(f"a.{index}") < F.col(f"b.{index}")))
    return pairs.groupBy(F.col(f"a.{group}").alias(group)).agg(F.count(F.lit(1)).alias("pair_count"), F.avg(distance).alias("diversity"))


@dataclass(frozen=True)
class Distance:
    """A symmetric distance of contents, on blocks of them: pack(contents) gives arrays of one row for each content, and
    between(a, b) of two such blocks all distances, and which of them are defined (None: all are)."""

    pack: Callable[[list], tuple]
    between: Callable[[tuple, tuple], tuple]


def byte_distance(size: int) -> Distance:
    """The share of the first `size` bytes that differ; to null, none does."""

    def pack(contents):
        out = np.full((len(contents), size), -1, dtype=np.int16)
        for row, c in zip(out, contents):
            if c is not None:
                row[: len(c)] = np.frombuffer(c, dtype=np.uint8)[:size]
        return out, np.array([c is not None for c in contents])

    def between(a, b):
        far = np.zeros((len(a[0]), len(b[0])), dtype=np.uint32)
        for one, two in zip(a[0].T, np.ascontiguousarray(b[0].T)):
            far += one[:, None] != two[None, :]
        far[~a[1]] = 0
        far[:, ~b[1]] = 0
        return far / size, None

    return Distance(pack, between)


def euclidean_distance(scale: float = 1.0) -> Distance:
    """Euclidean distance times scale; vectors of different lengths, null or with a null have none."""

    def pack(contents):
        whole = [c is not None and None not in c for c in contents]
        sizes = np.array([len(c) if ok else -1 for c, ok in zip(contents, whole)])
        out = np.zeros((len(contents), max(sizes.max(initial=0), 1)))
        for row, c, ok in zip(out, contents, whole):
            if ok:
                row[: len(c)] = c
        return out, sizes

    def between(a, b):
        (x, m), (y, n) = a, b
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
        with np.errstate(all="ignore"):
            p, q = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
            square = x @ (-2.0 * y.T)
            square += p
            square += q
            # A difference that is small beside the norms has lost digits: it is taken by components.
            good = square > 1e-3 * p + 1e-3 * q
            if not (np.isfinite(p).all() and np.isfinite(q).all()):
                good &= np.isfinite(square)
            i, j = np.nonzero(~good) if not good.all() else ((), ())
            for at in range(0, len(i), 1 << 15):
                k, h = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                square[k, h] = ((x[k] - y[h]) ** 2).sum(axis=1)
            np.sqrt(square, out=square)
            square *= scale
        alike = m[0] >= 0 and (m == m[0]).all() and (n == m[0]).all()
        return square, None if alike else (m[:, None] == n[None, :]) & (m >= 0)[:, None]

    return Distance(pack, between)


#: Rows of a tile that meet its other side at once.
_STRIP = 64


def _tile_sums(distance: Distance, contents: list, copies: np.ndarray, first: np.ndarray | None) -> tuple[int, float, float]:
    """(pairs, pairs with a distance, sum of distances) of a tile: of all rows with each other and with themselves as often
    as they have copies, or (first given) of the rows where it is true with the others."""
    rows = distance.pack(contents)
    part = lambda at: tuple(x[at] for x in rows)
    c = copies.astype(np.float64)
    defined = total = 0.0

    def add(matrix, known, left, right):
        nonlocal defined, total
        total += float(left @ (matrix if known is None else np.where(known, matrix, 0.0)) @ right)
        defined += float(left.sum() * right.sum() if known is None else left @ known @ right)

    if first is not None:
        one, two = np.nonzero(first)[0], np.nonzero(~first)[0]
        for at in range(0, len(one), _STRIP):
            k = one[at : at + _STRIP]
            add(*distance.between(part(k), part(two)), c[k], c[two])
        return int(copies[one].sum()) * int(copies[two].sum()), defined, total
    for at in range(0, len(c), _STRIP):
        here = slice(at, at + _STRIP)
        matrix, known = distance.between(part(here), part(slice(at, None)))
        own = len(matrix)
        add(matrix[:, own:], None if known is None else known[:, own:], c[here], c[at + own :])
        known = np.ones((own, own), dtype=bool) if known is None else known[:, :own]
        add(matrix[:, :own], np.triu(known, 1), c[here], c[here])
        add(np.diagonal(matrix)[None, :], np.diagonal(known)[None, :], np.ones(1), c[here] * (c[here] - 1) / 2)
    n = int(copies.sum())
    return n * (n - 1) // 2, defined, total


def content_diversity(df: DataFrame, group: str, content: str, distance: Distance, budget: int, unit_work: int = 1, tile: int = 4096) -> DataFrame:
    """Mean of a symmetric distance of contents over all unordered pairs of a group's rows, like pair_diversity().

    Equal contents are counted once, with their copies as weight, so the work
    is quadratic in a group's different contents alone; where those pairs, times
    unit_work, pass the budget the group is refused before any is made.  Pairs
    that have no distance are counted, but are not in the mean.

    The contents of a group fall into blocks of about `tile` by hash, and two
    blocks meet in one tile, a strip at a time: a tile's two blocks are all that
    a task holds.
    """
    distinct = df.groupBy(group, content).agg(F.count(F.lit(1)).alias("_c"))
    sizes = distinct.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / tile))
    seen = sizes.agg(F.max("_n").alias("largest"), F.sum(F.expr("_blocks * (_blocks + 1) div 2")).alias("tiles")).first()
    check_pair_budget(seen["largest"] or 0, unit_work, budget)
    # Groups of several blocks are fewer than contents by the size of a tile.
    large = F.broadcast(sizes.where("_blocks > 1").drop("_n"))
    blocks = F.coalesce("_blocks", F.lit(1).cast("long"))
    rows = distinct.join(large, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_block", F.pmod(F.xxhash64(content, F.lit(1)), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_other")
    tiles = rows.select(group, F.col(content).alias("_content"), "_c", "_block", other).withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other")).drop("_other")
    parts = min(max(seen["tiles"] or 1, 1), 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def sums(table: pa.Table) -> pa.Table:
        lo, hi = table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py()
        first = None if lo == hi else table.column("_block").to_numpy() == lo
        got = _tile_sums(distance, table.column("_content").to_pylist(), table.column("_c").to_numpy(), first)
        return pa.table({group: table.column(group).slice(0, 1), "pairs": pa.array([got[0]], pa.int64()), "defined": pa.array([got[1]], pa.float64()), "total": pa.array([got[2]], pa.float64())})

    schema = StructType([df.schema[group], StructField("pairs", LongType()), StructField("defined", DoubleType()), StructField("total", DoubleType())])
    # By number, so that tiles of few bytes and much work are not put together.
    met = tiles.repartition(parts, group, "_lo", "_hi").groupBy(group, "_lo", "_hi").applyInArrow(sums, schema)
    out = met.groupBy(group).agg(F.sum("pairs").alias("pair_count"), F.sum("defined").alias("_defined"), F.sum("total").alias("_total")).where("pair_count > 0")
    return out.select(group, "pair_count", F.when(F.col("_defined") > 0, F.col("_total") / F.col("_defined")).alias("diversity"))


def check_pair_budget(population: int, unit_work: int, budget: int) -> int:
    """Worst-case work of all pairs; raises where it is over the budget."""
    work = population * (population - 1) // 2 * unit_work
    if work > budget:
        raise ValueError(f"pair work {work} exceeds the budget {budget}")
    return work
