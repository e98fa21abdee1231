"""Measurement queries: line items as samples of return flags, by line status."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import measurement as m

from ._tables import table

_SAMPLES = """
WITH samples AS (
  SELECT l_returnflag AS workload, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'candidate' END AS subject,
         CASE WHEN l_linenumber = 1 THEN 'warmup' ELSE 'recorded' END AS phase,
         @CLEAN@ l_tax < 0.08 AS condition_ok, @CLEAN@ l_discount < 0.1 AS completed, @DIRTY@ l_suppkey % 10 = 3 AS timed_out, @DIRTY@ l_suppkey % 10 = 7 AS failed,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS runtime_ns, CAST(l_quantity * 1000 AS BIGINT) AS peak_memory, CAST(l_partkey AS BIGINT) AS binary_size, l_orderkey, l_linenumber
  FROM lineitem
)"""
_MARKED = """, med AS (
  SELECT workload, subject, (list_sort(list(runtime_ns))[(count(*) + 1) // 2] // 2) + (list_sort(list(runtime_ns))[count(*) // 2 + 1] // 2)
         + ((list_sort(list(runtime_ns))[(count(*) + 1) // 2] % 2 + list_sort(list(runtime_ns))[count(*) // 2 + 1] % 2) // 2) AS median
  FROM samples WHERE phase = 'recorded' AND condition_ok AND completed AND NOT timed_out AND NOT failed GROUP BY workload, subject
), marked AS (
  SELECT s.*, CASE WHEN phase = 'recorded' AND completed AND NOT timed_out AND NOT failed AND abs(runtime_ns - median) > @DEV@ THEN 'runtime-median-deviation'
                   WHEN NOT completed OR timed_out OR failed THEN 'incomplete-provider-sample' WHEN NOT condition_ok THEN 'condition-mismatch' END AS exclusion
  FROM samples AS s LEFT JOIN med ON s.workload = med.workload AND s.subject = med.subject
), used AS (SELECT * FROM marked WHERE phase = 'recorded' AND exclusion IS NULL),
agg AS (
  SELECT workload, subject, CAST(count(*) AS BIGINT) AS included_count, min(runtime_ns) AS runtime_min, max(runtime_ns) AS runtime_max,
         CAST(floor((list_sort(list(runtime_ns))[(count(*) + 1) // 2] + list_sort(list(runtime_ns))[count(*) // 2 + 1]) / 2) AS BIGINT) AS runtime_ns,
         CAST(floor((list_sort(list(peak_memory))[(count(*) + 1) // 2] + list_sort(list(peak_memory))[count(*) // 2 + 1]) / 2) AS BIGINT) AS peak_memory,
         CAST(floor((list_sort(list(binary_size))[(count(*) + 1) // 2] + list_sort(list(binary_size))[count(*) // 2 + 1]) / 2) AS BIGINT) AS binary_size
  FROM used GROUP BY workload, subject
), aggs AS (
  SELECT a.*, CAST((SELECT count(*) FROM marked AS k WHERE k.phase = 'recorded' AND k.exclusion IS NOT NULL AND k.workload = a.workload AND k.subject = a.subject) AS BIGINT) AS excluded_count,
         CAST((2 * (runtime_max - runtime_min) * 1000000 + runtime_ns) // (2 * runtime_ns) AS BIGINT) AS runtime_range_ppm
  FROM agg AS a
)"""
_DIRTY = _SAMPLES.replace("@CLEAN@", "").replace("@DIRTY@", "")
_CLEAN = _SAMPLES.replace("@CLEAN@", "true OR").replace("@DIRTY@", "false AND")
_DEVIATION = 2_000_000


def _samples(spark, sf_dir, clean: bool):
    c = F.col
    flag = lambda e, good: F.lit(good) if clean else e
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("workload"),
        F.when(c("l_linestatus") == "F", "baseline").otherwise("candidate").alias("subject"),
        F.when(c("l_linenumber") == 1, "warmup").otherwise("recorded").alias("phase"),
        flag(c("l_tax") < 0.08, True).alias("condition_ok"),
        flag(c("l_discount") < 0.1, True).alias("completed"),
        flag(c("l_suppkey") % 10 == 3, False).alias("timed_out"),
        flag(c("l_suppkey") % 10 == 7, False).alias("failed"),
        F.round(c("l_extendedprice") * 100).cast("long").alias("runtime_ns"),
        (c("l_quantity") * 1000).cast("long").alias("peak_memory"),
        c("l_partkey").alias("binary_size"),
        "l_orderkey",
        "l_linenumber",
    )


@query(_DIRTY + _MARKED.replace("@DEV@", "9223372036854775806") + """
SELECT workload, subject, included_count, excluded_count, runtime_min, runtime_max, runtime_ns, peak_memory, binary_size, runtime_range_ppm FROM aggs""")
def measurement_aggregate(spark, sf_dir):
    return m.aggregate_subjects(m.mark_outliers(_samples(spark, sf_dir, False), None), ["runtime_ns", "peak_memory", "binary_size"])


@query(_DIRTY + _MARKED.replace("@DEV@", str(_DEVIATION)) + """
SELECT workload, subject, phase, coalesce(exclusion, 'included') AS exclusion, CAST(count(*) AS BIGINT) AS samples, CAST(sum(runtime_ns) AS BIGINT) AS runtime_sum
FROM marked GROUP BY ALL""")
def measurement_outliers(spark, sf_dir):
    marked = m.mark_outliers(_samples(spark, sf_dir, False), _DEVIATION)
    return marked.groupBy("workload", "subject", "phase", F.coalesce("exclusion", F.lit("included")).alias("exclusion")).agg(F.count(F.lit(1)).alias("samples"), F.sum("runtime_ns").alias("runtime_sum"))


_COMPARED = """, wide AS (
  SELECT b.workload, b.runtime_ns AS br, c.runtime_ns AS cr, b.runtime_range_ppm AS bp, c.runtime_range_ppm AS cp, b.peak_memory AS bm, c.peak_memory AS cm, b.binary_size AS bb, c.binary_size AS cb,
         (SELECT bool_and(completed AND NOT timed_out AND NOT failed AND condition_ok) FROM marked AS k WHERE k.workload = b.workload) AS complete
  FROM aggs AS b JOIN aggs AS c ON b.workload = c.workload AND b.subject = 'baseline' AND c.subject = 'candidate'
), verdicts AS (
  SELECT workload, complete, complete AND bp <= @RANGE@ AND cp <= @RANGE@ AS stable, br, cr, bm, cm, bb, cb,
         CASE WHEN NOT complete THEN 'incomplete' WHEN NOT (bp <= @RANGE@ AND cp <= @RANGE@) THEN 'unstable'
              WHEN (br - cr) * 1000000 < -br * 1000 THEN 'slower' WHEN (br - cr) * 1000000 > br * 1000 AND (br - cr) * 1000000 >= br * 5000 THEN 'faster' ELSE 'equal' END AS comparison
  FROM wide
)"""


def _verdicts(spark, sf_dir, clean: bool, max_range: int):
    marked = m.mark_outliers(_samples(spark, sf_dir, clean), _DEVIATION)
    aggregates = m.aggregate_subjects(marked, ["runtime_ns", "peak_memory", "binary_size"])
    return m.compare_workloads(marked, aggregates, tolerance_ppm=1000, minimum_ppm=5000, max_range_ppm=max_range, minimum_included=3)


_LINES = "SELECT workload, complete, stable, comparison, round(CASE WHEN stable THEN CAST(br - cr AS DOUBLE) / br ELSE 0 END, 6) AS runtime_improvement, round(CASE WHEN stable THEN (CAST(bm - cm AS DOUBLE) / bm + CAST(bb - cb AS DOUBLE) / bb) / 2 ELSE 0 END, 6) AS memory_improvement FROM verdicts"


def _lines(df):
    return df.select("workload", "complete", "stable", "comparison", F.round("runtime_improvement", 6).alias("runtime_improvement"), F.round("memory_improvement", 6).alias("memory_improvement"))


@query((_CLEAN + _MARKED + _COMPARED).replace("@DEV@", str(_DEVIATION)).replace("@RANGE@", "4000000") + _LINES)
def measurement_compare(spark, sf_dir):
    return _lines(_verdicts(spark, sf_dir, True, 4_000_000))


@query((_CLEAN + _MARKED + _COMPARED).replace("@DEV@", str(_DEVIATION)).replace("@RANGE@", "100000") + _LINES)
def measurement_unstable(spark, sf_dir):
    return _lines(_verdicts(spark, sf_dir, True, 100_000))


@query((_DIRTY + _MARKED + _COMPARED).replace("@DEV@", str(_DEVIATION)).replace("@RANGE@", "4000000") + _LINES)
def measurement_incomplete(spark, sf_dir):
    return _lines(_verdicts(spark, sf_dir, False, 4_000_000))


@query((_CLEAN + _MARKED + _COMPARED).replace("@DEV@", str(_DEVIATION)).replace("@RANGE@", "4000000") + """
SELECT CASE WHEN bool_or(comparison = 'incomplete') THEN 'incomplete' WHEN bool_or(comparison = 'unstable') THEN 'unstable' WHEN bool_or(comparison = 'slower') THEN 'slower'
            WHEN bool_or(comparison = 'faster') THEN 'faster' ELSE 'equal' END AS comparison,
       round(avg(CAST(br - cr AS DOUBLE) / br), 6) AS performance, NOT bool_or(comparison IN ('incomplete', 'unstable')) AS fitness_available FROM verdicts""")
def measurement_overall(spark, sf_dir):
    return m.overall(_verdicts(spark, sf_dir, True, 4_000_000)).withColumn("performance", F.round("performance", 6))


@query((_CLEAN + _MARKED + _COMPARED).replace("@DEV@", str(_DEVIATION)).replace("@RANGE@", "4000000") + """,
w AS (SELECT CASE workload WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 3.0 END AS weight, CAST(br - cr AS DOUBLE) / br AS r, (CAST(bm - cm AS DOUBLE) / bm + CAST(bb - cb AS DOUBLE) / bb) / 2 AS y FROM verdicts)
SELECT round(CAST(sum(weight * r) / sum(weight) AS DOUBLE), 6) AS performance, round(CAST(sum(weight * y) / sum(weight) AS DOUBLE), 6) AS memory_use,
       round(CAST(0.4 + sum(weight * r) / sum(weight) * 0.4 + sum(weight * y) / sum(weight) * 0.2 AS DOUBLE), 6) AS total, true AS fitness_available FROM w""")
def measurement_fitness(spark, sf_dir):
    rows = _verdicts(spark, sf_dir, True, 4_000_000).withColumn("weight", F.expr("CASE workload WHEN 'A' THEN 1D WHEN 'N' THEN 2D ELSE 3D END"))
    out = m.weighted_fitness(rows, {"correctness": 0.4, "performance": 0.4, "memory_use": 0.2}, order="workload")
    return out.select(*[F.round(c, 6).alias(c) for c in ("performance", "memory_use", "total")], "fitness_available")


_GAINS = """
WITH p AS (SELECT p_brand AS workload, CAST(1 + p_size % 4 AS DOUBLE) AS weight, count(*) OVER (PARTITION BY p_brand) AS n, p_partkey, p_size, p_retailprice FROM part),
m AS (SELECT workload, CAST(min(p_size) * 1000 AS BIGINT) AS bm, CAST(max(p_size) * 900 AS BIGINT) AS cm, CAST(min(p_partkey) + 5000 AS BIGINT) AS bb, CAST(max(p_partkey) + 100 AS BIGINT) AS cb,
             CAST(900000 AS BIGINT) AS br, CAST(900000 + min(p_size) * 1000 AS BIGINT) AS cr FROM p GROUP BY workload),
g AS (SELECT workload, (CAST(bm - cm AS DOUBLE) / bm * 3 + CAST(bb - cb AS DOUBLE) / bb * 1) / 4 AS memory, CAST(cr - br AS DOUBLE) / 1000000 AS reliability FROM m)"""


@query(_GAINS + """
SELECT workload, round(memory, 6) AS memory_improvement, round(reliability, 6) AS reliability_improvement FROM g""")
def measurement_mix(spark, sf_dir):
    """Memory gains with a policy's own mix of peak memory and binary size, and gains in millionths."""
    return _mixed(spark, sf_dir).select("workload", F.round("memory_improvement", 6).alias("memory_improvement"), F.round("reliability_improvement", 6).alias("reliability_improvement"))


def _mixed(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("workload")).agg(F.min("p_size").cast("long").alias("s"), F.max("p_size").cast("long").alias("t"), F.min("p_partkey").alias("k"), F.max("p_partkey").alias("l"))
    side = lambda who, memory, size, reliability: p.select("workload", F.lit(who).alias("subject"), F.lit(3).alias("included_count"), F.lit(1000).cast("long").alias("runtime_ns"), F.lit(0).cast("long").alias("runtime_range_ppm"), memory.alias("peak_memory"), size.alias("binary_size"), reliability.cast("long").alias("reliability"))
    aggregates = side("baseline", F.col("s") * 1000, F.col("k") + 5000, F.lit(900_000)).union(side("candidate", F.col("t") * 900, F.col("l") + 100, F.lit(900_000) + F.col("s") * 1000))
    fine = [F.lit(True).alias(c) for c in ("completed", "condition_ok")] + [F.lit(False).alias(c) for c in ("timed_out", "failed")]
    return m.compare_workloads(p.select("workload", *fine), aggregates, 1000, 5000, 100, 3, memory_mix=(3.0, 1.0))


@query(_GAINS + """
SELECT round(avg(memory), 6) AS memory_use, round(avg(reliability), 6) AS reliability, round(0.5 + avg(memory) * 0.3 + avg(reliability) * 0.2, 6) AS total FROM g""")
def measurement_fitness_parts(spark, sf_dir):
    out = m.weighted_fitness(_mixed(spark, sf_dir).withColumn("weight", F.lit(2.0)), {"correctness": 0.5, "memory_use": 0.3, "reliability": 0.2}, order="workload")
    return out.select(*[F.round(c, 6).alias(c) for c in ("memory_use", "reliability", "total")])
