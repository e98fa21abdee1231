"""Stable ranks, selection weights, ticket intervals and running bests as windows.

The total order everywhere: larger total first, then the earlier row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import total_rank


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def rank_intervals(df: DataFrame, group: str, index: str, total: str, base: int = 1, step: int = 1) -> DataFrame:
    """Adds rank (0 is best), weight and the half-open ticket interval [ticket_from, ticket_to).

    Weights fall linearly with rank: base + (n - 1 - rank) * step.  Tickets are
    laid out in index order, not in rank order.
    """
    by_rank = Window.partitionBy(group).orderBy(F.desc(total), F.asc(index))
    whole = Window.partitionBy(group)
    before = Window.partitionBy(group).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("rank", (F.row_number().over(by_rank) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(whole))
    weighted = ranked.withColumn("weight", base + (F.col("_n") - 1 - F.col("rank")) * step)
    return weighted.withColumn("ticket_to", F.sum("weight").over(before)).withColumn("ticket_from", F.col("ticket_to") - F.col("weight")).drop("_n")


def weight_total(n: Column, base: int = 1, step: int = 1) -> Column:
    """Closed form of the sum of rank weights over n rows (a long, not negative); the even factor is halved first."""
    pairs = F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))
    return n * F.lit(base).cast("long") + pairs * F.lit(step).cast("long")


def pick_by_ticket(intervals: DataFrame, draws: DataFrame, group: str, ticket: str) -> DataFrame:
    """The row whose interval holds each draw's ticket: draws' columns, then those of the intervals."""
    return meet_in_buckets(intervals, draws, group, ticket).select(*draws.columns, *[c for c in intervals.columns if c not in draws.columns])


#: Intervals of a bucket, about.
BUCKET = 32


def meet_in_buckets(intervals: DataFrame, draws: DataFrame, group: str, ticket: str) -> DataFrame:
    """draws joined with the interval of their group that holds their ticket, as an equi-join.

    intervals(group, ticket_from, ticket_to, ...) are half-open and disjoint in
    a group.  Each group's tickets are cut at a width that leaves about BUCKET
    intervals in a bucket; an interval is repeated for the buckets that it
    touches, which adds a row for each bucket, and a draw looks in one bucket
    alone.  A group may be of any size.
    """
    clash = [c for c in intervals.columns if c in draws.columns]
    i = intervals.select(*[F.col(c).alias(f"_i_{c}" if c in clash else c) for c in intervals.columns])
    key, low, high = (f"_i_{c}" if c in clash else c for c in (group, "ticket_from", "ticket_to"))
    widths = intervals.groupBy(F.col(group).alias("_wide")).agg(F.ceil((F.max("ticket_to") - F.min("ticket_from")) * BUCKET / F.count(F.lit(1))).alias("_width"))
    width = F.greatest(F.col("_width"), F.lit(1))
    i = i.join(widths, F.col(key).eqNullSafe(F.col("_wide"))).where(F.col(low) < F.col(high))
    first, last = F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)
    i = i.select("*", F.explode(F.sequence(first, last)).alias("_cell")).drop("_wide", "_width")
    d = draws.join(widths, F.col(group).eqNullSafe(F.col("_wide"))).withColumn("_bucket", F.floor(F.col(ticket) / width)).drop("_wide", "_width")
    same = F.col(group).eqNullSafe(F.col(key)) & (F.col("_bucket") == F.col("_cell"))
    return d.join(i, same & (F.col(ticket) >= F.col(low)) & (F.col(ticket) < F.col(high))).drop("_bucket", "_cell", *[f"_i_{c}" for c in clash])


def valid_ordinals(df: DataFrame, group: str | None, index: str, valid: Column) -> DataFrame:
    """0-based ordinal of each valid row in index order; only valid rows stay."""
    if group is None:
        return total_rank(df.where(valid), [F.col(index)], "ordinal")
    order = Window.partitionBy(group).orderBy(index)
    return df.where(valid).withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def elites(df: DataFrame, group: str, index: str, total: str, k: int, population: int | None = None) -> DataFrame:
    """The k best rows of each group, with their slot at the end of the next population (best first)."""
    order = Window.partitionBy(group).orderBy(F.desc(total), F.asc(index))
    size = F.lit(population) if population is not None else F.count(F.lit(1)).over(Window.partitionBy(group))
    ranked = df.withColumn("_size", size.cast("long")).withColumn("elite_rank", (F.row_number().over(order) - 1).cast("long"))
    best = ranked.where(F.col("elite_rank") < k)
    return best.withColumn("slot", F.col("_size") - F.least("_size", F.lit(k).cast("long")) + F.col("elite_rank")).drop("_size")


def elite_counts(n: Column, valid: Column, explicit: Column) -> tuple[Column, Column, Column]:
    """(requested, effective, offspring): explicit count, or n mod 2 where none is given, held to the valid rows."""
    requested = F.coalesce(explicit, n % 2)
    effective = F.least(requested, valid)
    return requested, effective, n - effective


def running_best(df: DataFrame, group: str, order: list[str], total: str) -> DataFrame:
    """Adds best_total so far and improved: only a strictly larger total moves the best."""
    w = Window.partitionBy(group).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max(total).over(before)
    return df.withColumn("best_total", F.max(total).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("improved", F.coalesce(F.col(total) > best_before, F.lit(True)))


def wave_assignment(df: DataFrame, index: Column, workers: int) -> DataFrame:
    """Worker (from 1) and wave of each row: functions of its index alone."""
    return df.withColumn("worker", (F.pmod(index, F.lit(workers)) + 1).cast("long")).withColumn("wave", F.floor(index / workers).cast("long"))


def storage_registry(generations: DataFrame) -> DataFrame:
    """Which of two owners is active in a generation and how often each was used before; generation is a long column."""
    g = F.col("generation")
    half = F.floor(g / 2).cast("long")
    return generations.select(
        "generation", (g % 2 + 1).cast("long").alias("active_owner"), (2 - g % 2).cast("long").alias("idle_owner"), half.alias("first_reuses"), (half + g % 2).cast("long").alias("second_uses")
    )


def measurement_plan(workloads: DataFrame, workload: str, warmups: int, pairs: int) -> DataFrame:
    """Two samples for each pair: warm-ups first, then recorded pairs; odd pairs swap the subjects' order.

    Adds phase, pair_index, position, subject and the 0-based sequence within the workload.
    """
    rows = workloads.select(workload, F.explode(F.sequence(F.lit(0), F.lit(warmups + pairs - 1))).alias("_k"))
    recorded = F.col("_k") >= warmups
    rows = rows.select(workload, F.when(recorded, "recorded").otherwise("warmup").alias("phase"), F.when(recorded, F.col("_k") - warmups).otherwise(F.col("_k")).cast("long").alias("pair_index"), "_k")
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    subject = F.when((F.col("pair_index") + F.col("position")) % 2 == 0, "baseline").otherwise("candidate")
    return rows.select(workload, "phase", "pair_index", F.col("position").cast("long").alias("position"), subject.alias("subject"), (F.col("_k") * 2 + F.col("position")).cast("long").alias("sequence_index"))


def kth_row(df: DataFrame, group: str, order: list[str], selector: Column) -> DataFrame:
    """Of each group in the given order, the row numbered selector mod the group's size."""
    w = Window.partitionBy(group).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("_k", F.row_number().over(w) - 1).withColumn("pair_count", n).where(F.col("_k") == F.pmod(selector, F.col("pair_count"))).drop("_k")
