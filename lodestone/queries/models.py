"""The four-byte models, evaluated on customers and over all their residues, and the rest of the evidence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import models

from ._tables import table

_TOTALS = """
m AS (
  SELECT id, 'repository-scoring' AS model, 4 + b0 % 8 + b1 % 8 + b2 % 8 + b3 % 8 <= 24 AS valid,
         30 * (4 + b0 % 8 + b1 % 8 + b2 % 8 + b3 % 8) - 50 * greatest(2 - b3 % 8, 0) AS total FROM g
  UNION ALL
  SELECT id, 'compiler-options', NOT (b0 % 4 = 0 AND b3 % 2 = 1) AND NOT (b1 % 5 = 4 AND b2 % 4 = 0),
         1200 + 300 * (b0 % 4) + 75 * (b1 % 5) + 60 * (b2 % 4) + 200 * (b3 % 2) - 3 * greatest(40 * (b1 % 5) + 25 * (b2 % 4) + 30 * (b3 % 2) - 180, 0) FROM g
  UNION ALL
  SELECT id, 'scheduler', b1 % 8 <= b2 % 8 AND 1 + b0 % 8 + b3 % 5 <= 10,
         1600 + 180 * (1 + b1 % 8) + 95 * (1 + b2 % 8) + 40 * (1 + b0 % 8) + 117 - 20 * (b3 % 5) - 90 * greatest(b2 % 8 - 5, 0) FROM g
  UNION ALL
  SELECT id, 'placement', b0 % 8 + b1 % 8 <= 10 AND b2 % 8 <= 6,
         1100 + 220 * (b2 % 8) + 300 - 20 * (abs(b0 % 8 - 4) + abs(b1 % 8 - 4)) + 60 * (b3 % 8)
         - 120 * greatest(18 - b2 % 8 - b3 % 8 // 2 - 10, 0) - 2 * greatest(300 + 80 * (b2 % 8) + 35 * (b3 % 8) - 900, 0) FROM g
)"""


def _evaluated(genomes):
    bytes_ = [F.col(f"b{i}") for i in range(4)]
    out = None
    for name, model in models.MODELS.items():
        valid, total = model(bytes_)
        one = genomes.select("id", F.lit(name).alias("model"), valid.alias("valid"), total.cast("long").alias("total"))
        out = one if out is None else out.union(one)
    return out


@query("WITH g AS (SELECT c_custkey AS id, c_custkey * 7 % 256 AS b0, c_custkey * 11 % 256 AS b1, c_custkey * 13 % 256 AS b2, c_custkey * 17 % 256 AS b3 FROM customer)," + _TOTALS + """
SELECT id, model, valid, CAST(total AS BIGINT) AS total FROM m""")
def model_totals(spark, sf_dir):
    k = F.col("c_custkey")
    return _evaluated(table(spark, sf_dir, "customer").select(k.alias("id"), *[(k * n % 256).alias(f"b{i}") for i, n in enumerate((7, 11, 13, 17))]))


@query("WITH g AS (SELECT 0 AS id, a.i AS b0, b.i AS b1, c.i AS b2, d.i AS b3 FROM range(0, 8) AS a(i), range(0, 8) AS b(i), range(0, 8) AS c(i), range(0, 8) AS d(i))," + _TOTALS + """
SELECT model, CAST(max(CASE WHEN valid THEN total END) AS BIGINT) AS best_total FROM m GROUP BY model""")
def model_best(spark, sf_dir):
    """The best valid total of each model, over all residues of its bytes."""
    n = F.col("id")
    grid = spark.range(8**4).select("id", *[(F.floor(n / 8**i) % 8).cast("long").alias(f"b{i}") for i in range(4)])
    return _evaluated(grid).groupBy("model").agg(F.max(F.when(F.col("valid"), F.col("total"))).alias("best_total"))


@query("""
WITH s AS (SELECT c_custkey, c_custkey % 13 <> 0 AS a, c_custkey % 7 <> 0 AS b, c_custkey % 5 <> 0 AS c, c_custkey % 3 <> 0 AS d FROM customer)
SELECT c_custkey, CASE WHEN NOT a THEN 'provider' WHEN NOT b THEN 'correctness' WHEN NOT c THEN 'assurance' WHEN NOT d THEN 'measurement' ELSE 'none' END AS rejection,
       CASE WHEN NOT a OR NOT b THEN 'build-failed' WHEN NOT c THEN 'correctness-failed' WHEN NOT d THEN 'benchmark-ineligible' ELSE 'eligible' END AS baseline FROM s
""")
def candidate_rejections(spark, sf_dir):
    """Why a candidate is refused, the first reason in order; and what a baseline's four stages make of it."""
    from lodestone.operators.assurance import baseline_state, rejection

    k = F.col("c_custkey")
    flags = [k % n != 0 for n in (13, 7, 5, 3)]
    return table(spark, sf_dir, "customer").select("c_custkey", rejection(*flags).alias("rejection"), baseline_state(*flags).alias("baseline"))


@query("""
SELECT l_returnflag, quantile_disc(CAST(round(l_extendedprice * 100) AS BIGINT), 0.5) AS lower_median, CAST(min(round(l_extendedprice * 100)) AS BIGINT) AS low, CAST(max(round(l_extendedprice * 100)) AS BIGINT) AS high,
       CAST(count(*) - count(DISTINCT l_partkey) AS BIGINT) AS collisions, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY l_returnflag
""")
def research_statistics(spark, sf_dir):
    """Lower median, extremes, collision count and correlation of each flag."""
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_quantity", "l_extendedprice", price.alias("cents"))
    from lodestone.operators.measurement import lower_medians

    distinct = rows.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("d"))
    facts = rows.groupBy("l_returnflag").agg(F.min("cents").alias("low"), F.max("cents").alias("high"), F.count(F.lit(1)).alias("n"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"))
    out = facts.join(distinct, "l_returnflag").join(lower_medians(rows, ["l_returnflag"], "cents"), "l_returnflag")
    return out.select("l_returnflag", F.col("cents").alias("lower_median"), "low", "high", (F.col("n") - F.col("d")).alias("collisions"), "correlation")


@query("""
WITH h AS (SELECT o_orderkey, bit_count(xor(o_orderkey * 2654435761 % 4294967296, (o_orderkey + 1) * 2654435761 % 4294967296)) AS d FROM orders)
SELECT CAST(d // 2 AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY 1
""")
def avalanche_histogram(spark, sf_dir):
    """Hamming distances of neighbouring keys' hashes, in bins of two bits."""
    k = F.col("o_orderkey")
    h = lambda x: x * 2654435761 % 4294967296
    d = F.bit_count(h(k).bitwiseXOR(h(k + 1)))
    return table(spark, sf_dir, "orders").groupBy(F.floor(d / 2).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
