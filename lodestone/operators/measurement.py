"""Comparison of baseline and candidate samples: exact integer medians, outliers, ranges, verdicts and fitness.

Samples have workload, subject ('baseline' or 'candidate'), phase ('warmup' or
'recorded'), condition_ok, completed, timed_out, failed and integer measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import few

PPM = 1_000_000
PPM_CAP = 4_294_967_295
#: Worst first.
COMPARISONS = ("incomplete", "unstable", "slower", "faster", "equal")
#: A sketch's ranks are off by at most 1 / ACCURACY of a group's rows; its bounds lie ten times as far from the middle.
ACCURACY = 10_000
BOUNDS = [0.5 - 10 / ACCURACY, 0.5 + 10 / ACCURACY]


def _around_middle(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, _m (a measure), _v (its distinct values around the middle), _lo and _hi (rows before and with it), _n.

    All measures are unpivoted.  A mergeable sketch gives bounds on both sides
    of each group's middle; one more pass counts the rows below, and by value
    only the few between the bounds, so that what a task holds does not grow
    with the different values of a measure: a group may be as large as the input.
    """
    pairs = ", ".join(f"'{v}', cast({v} as bigint)" for v in values)
    long = df.select(*keys, F.expr(f"stack({len(values)}, {pairs}) as (_m, _v)")).where("_v is not null")
    by = [*keys, "_m"]
    sketch = long.groupBy(*by).agg(F.percentile_approx("_v", BOUNDS, ACCURACY).alias("_b"))
    bound = lambda k: F.get("_b", F.lit(k)).cast("decimal(38,0)")
    # The sketch works in doubles: its bounds are moved out by more than a double can be off.
    wider = lambda k, way: bound(k) + way * (F.floor(F.abs(bound(k)) / F.lit(1 << 48)) + 1)
    bounds = sketch.select(*by, wider(0, -1).alias("_from"), wider(1, 1).alias("_to"))
    within = F.when(F.expr("_v between _from and _to"), F.col("_v")).alias("_v")
    counts = long.join(few(bounds), by).groupBy(*by, within).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_v") < F.col("_from")).alias("_below"))
    group = Window.partitionBy(*by)
    near = counts.withColumn("_n", F.sum("_c").over(group)).withColumn("_below", F.sum("_below").over(group)).where("_v is not null")
    upto = F.sum("_c").over(group.orderBy("_v")) + F.col("_below")
    return near.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_c"))


def integer_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact lower-rounded medians of whole numbers for each group, one column each (null without values).

    An even count gives the floor of the mean of the two middle values, without overflow.
    """
    at = lambda k: F.max(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col("_v")))
    middle = _around_middle(df, keys, values).groupBy(*keys, "_m").agg(at(F.expr("(_n - 1) div 2")).alias("_a"), at(F.expr("_n div 2")).alias("_b"))
    one = middle.select(*keys, "_m", _middle(F.col("_a"), F.col("_b")).alias("_x"))
    return one.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == v, F.col("_x"))).alias(v) for v in values])


def _middle(a: Column, b: Column) -> Column:
    return F.shiftright(a, 1) + F.shiftright(b, 1) + F.shiftright(a.bitwiseAND(F.lit(1)) + b.bitwiseAND(F.lit(1)), 1)


def range_ppm(low: Column, high: Column, median: Column) -> Column:
    """(high - low) / median in millionths, rounded half up by whole-number arithmetic; median 0 gives 10**6."""
    exact = (F.lit(2).cast("decimal(38,0)") * (high - low).cast("decimal(20,0)") * F.lit(PPM) + median.cast("decimal(20,0)"))
    rounded = F.floor(exact / (F.lit(2) * median.cast("decimal(20,0)")))
    return F.when((median == 0) | (high < low), F.lit(PPM).cast("long")).otherwise(F.least(rounded, F.lit(PPM_CAP)).cast("long"))


def includable() -> Column:
    return F.col("condition_ok") & F.col("completed") & ~F.col("timed_out") & ~F.col("failed")


def mark_outliers(samples: DataFrame, deviation: int | None) -> DataFrame:
    """Adds exclusion: 'condition-mismatch', 'incomplete-provider-sample', 'runtime-median-deviation' or null.

    The median is taken over the includable recorded samples of a workload and
    subject; the deviation applies to every completed recorded sample and
    overrides a condition mismatch.
    """
    whole = ~F.col("completed") | F.col("timed_out") | F.col("failed")
    recorded = F.col("phase") == "recorded"
    reason = F.when(whole, "incomplete-provider-sample").when(~F.col("condition_ok"), "condition-mismatch")
    if deviation is None:
        return samples.withColumn("exclusion", reason)
    keys = ["workload", "subject"]
    medians = integer_medians(samples.where(recorded & includable()), keys, ["runtime_ns"]).withColumnRenamed("runtime_ns", "_median")
    far = recorded & ~whole & (F.abs(F.col("runtime_ns") - F.col("_median")) > deviation)
    return samples.join(few(medians), keys, "left").withColumn("exclusion", F.when(F.coalesce(far, F.lit(False)), "runtime-median-deviation").otherwise(reason)).drop("_median")


def aggregate_subjects(marked: DataFrame, measures: list[str]) -> DataFrame:
    """For each workload and subject: counts, exact medians of the measures, and the runtime's extremes and range."""
    keys = ["workload", "subject"]
    recorded = marked.where(F.col("phase") == "recorded")
    used = recorded.where("exclusion is null")
    counts = recorded.groupBy(*keys).agg(
        F.count_if(F.col("exclusion").isNull()).alias("included_count"),
        F.count_if(F.col("exclusion").isNotNull()).alias("excluded_count"),
        F.min(F.when(F.col("exclusion").isNull(), F.col("runtime_ns"))).alias("runtime_min"),
        F.max(F.when(F.col("exclusion").isNull(), F.col("runtime_ns"))).alias("runtime_max"),
    )
    out = counts.join(integer_medians(used, keys, measures), keys, "left")
    return out.withColumn("runtime_range_ppm", range_ppm(F.col("runtime_min"), F.col("runtime_max"), F.col("runtime_ns")))


def compare(baseline: Column, candidate: Column, tolerance_ppm: int, minimum_ppm: int) -> Column:
    """'slower', 'faster' or 'equal' by cross-multiplied whole numbers; 'incomplete' where the baseline is 0."""
    change = (baseline - candidate).cast("decimal(20,0)") * F.lit(PPM)
    base = baseline.cast("decimal(20,0)")
    faster = (change > base * tolerance_ppm) & (change >= base * minimum_ppm)
    return F.when(baseline == 0, "incomplete").when(change < -base * tolerance_ppm, "slower").when(faster, "faster").otherwise("equal")


def improvement(baseline: Column, candidate: Column) -> Column:
    return F.when(baseline == 0, 0.0).otherwise((baseline.cast("double") - candidate.cast("double")) / baseline.cast("double"))


def compare_workloads(
    marked: DataFrame, aggregates: DataFrame, tolerance_ppm: int, minimum_ppm: int, max_range_ppm: int, minimum_included: int, memory_mix: tuple[float, float] = (1.0, 1.0)
) -> DataFrame:
    """One row per workload: complete, stable, comparison and the improvements of both subjects' medians.

    A workload with any incomplete sample, warm-ups included, or with a
    condition mismatch is not complete.  memory_mix: the weights of peak memory
    and of binary size in memory_improvement.  Measures in millionths
    (reliability, maintainability) gain by their difference.
    """
    broken = marked.groupBy("workload").agg(F.bool_or(~(F.col("completed") & ~F.col("timed_out") & ~F.col("failed") & F.col("condition_ok"))).alias("_broken"))
    value = lambda c, who: F.max(F.when(F.col("subject") == who, F.col(c))).alias(f"{who}_{c}")
    cols = ["included_count", "runtime_ns", "runtime_range_ppm", "peak_memory", "binary_size", "reliability", "maintainability"]
    cols = [c for c in cols if c in aggregates.columns]
    wide = aggregates.groupBy("workload").agg(*[value(c, who) for c in cols for who in ("baseline", "candidate")]).join(broken, "workload")
    enough = lambda who: F.coalesce(F.col(f"{who}_included_count") >= minimum_included, F.lit(False))
    complete = ~F.col("_broken") & enough("baseline") & enough("candidate")
    steady = (F.col("baseline_runtime_range_ppm") <= max_range_ppm) & (F.col("candidate_runtime_range_ppm") <= max_range_ppm)
    wide = wide.withColumn("complete", complete).withColumn("stable", complete & steady)
    verdict = F.when(~F.col("complete"), "incomplete").when(~F.col("stable"), "unstable").otherwise(compare(F.col("baseline_runtime_ns"), F.col("candidate_runtime_ns"), tolerance_ppm, minimum_ppm))
    gain = lambda c: F.when(F.col("stable"), improvement(F.col(f"baseline_{c}"), F.col(f"candidate_{c}"))).otherwise(0.0)
    out = wide.withColumn("comparison", verdict).withColumn("runtime_improvement", gain("runtime_ns"))
    if "peak_memory" in cols and "binary_size" in cols:
        peak, binary = (float(w) for w in memory_mix)
        out = out.withColumn("memory_improvement", (gain("peak_memory") * peak + gain("binary_size") * binary) / (peak + binary))
    for c in ("reliability", "maintainability"):
        if c in cols:
            grown = (F.col(f"candidate_{c}") - F.col(f"baseline_{c}")).cast("double") / float(PPM)
            out = out.withColumn(f"{c}_improvement", F.when(F.col("stable"), grown).otherwise(0.0))
    return out.drop("_broken")


def overall(workloads: DataFrame) -> DataFrame:
    """The worst comparison of all workloads, and the mean improvement where all are stable."""
    worst = F.lit("equal")
    for name in reversed(COMPARISONS):
        worst = F.when(F.bool_or(F.col("comparison") == name), name).otherwise(worst)
    usable = ~F.bool_or(F.col("comparison").isin("incomplete", "unstable"))
    return workloads.agg(worst.alias("comparison"), F.when(usable, F.avg("runtime_improvement")).alias("performance"), usable.alias("fitness_available"))


def weighted_fitness(workloads: DataFrame, weights: dict[str, float], weight: str = "weight", order: str | None = None) -> DataFrame:
    """Weight-averaged component gains, and the total: component weights times components, less the weighted penalty.

    Correctness is 1 and the penalty 0 for a candidate that got here; gains that
    the rows do not have are 0.  order: sums run in this column's order, so they
    have the same bits whatever the partitioning (workloads are few: a policy
    bounds them).  fitness_available: the total is finite.
    """
    parts = {"performance": "runtime_improvement", "memory_use": "memory_improvement", "reliability": "reliability_improvement", "maintainability": "maintainability_improvement"}
    item = F.struct(F.col(order or weight).alias("o"), F.col(weight).cast("double").alias("w"), *[F.col(c).alias(n) for n, c in parts.items() if c in workloads.columns])
    rows = workloads.agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    summed = lambda f: F.aggregate("_rows", F.lit(0.0), lambda s, r: s + f(r))
    mean = lambda n: summed(lambda r: r["w"] * r[n]) / summed(lambda r: r["w"])
    out = rows.select(F.lit(1.0).alias("correctness"), *[(mean(n) if c in workloads.columns else F.lit(0.0)).alias(n) for n, c in parts.items()], F.lit(0.0).alias("constraint_penalty"))
    total = F.lit(0.0)
    for n in ("correctness", *parts):
        total = total + F.col(n) * float(weights.get(n, 0.0))
    out = out.withColumn("total", total - F.col("constraint_penalty") * float(weights.get("constraint_penalty", 0.0)))
    return out.withColumn("fitness_available", ~F.isnan("total") & (F.abs("total") < float("inf")))


def lower_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The lower of the two middle values (or the middle one) of whole numbers, found like integer_medians()."""
    first = F.expr("(_n - 1) div 2")
    return _around_middle(df, keys, [value]).where((F.col("_lo") <= first) & (first < F.col("_hi"))).select(*keys, F.col("_v").alias(value))
