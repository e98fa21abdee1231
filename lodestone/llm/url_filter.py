"""URL filter: suffix rules, and a character language-model ratio for what no rule covers.

Two smoothed variable-order Markov models over characters, one of URLs that
rules accept and one of those they reject, give each URL the difference of its
log likelihoods divided by its length.  The cut is calibrated halfway between
the mean scores of the two rule-labelled classes.

Everything is DataFrame operations.  Characters are mapped to a fixed alphabet,
so the table of all (two-character context, character) differences has a fixed
size (ALPHABET**3 entries of 8 bytes).  It is computed once from n-gram counts
and looked up by position as a scalar array: scoring needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are told apart; place 0 is the start of a URL, the last place every other character.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-./:?=_&#%"
ALPHABET = len(CHARACTERS) + 2
ORDER = 2
#: Scores are whole multiples of 1/UNIT nats, so that sums do not depend on their order.
UNIT = 1_000_000
#: (host, path, verdict), the fixed rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hosts_and_paths(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rest = F.expr("CASE WHEN url IS NULL OR locate('://', url) = 0 THEN '' ELSE substring(url, locate('://', url) + 3) END")
    rows = rows.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", r"(?s)\A[^/?#]*", 0))
    tail = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"(?s)\A[^?#]*", 0)
    return rows.select("page_id", F.translate("_host", _CAPITALS, _SMALL).alias("host"), tail.alias("path"), F.coalesce("url", F.lit("")).alias("url"))


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones, which are longer, go first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _codes(text: Column) -> Column:
    """Array of the characters' places in the alphabet, after ORDER starts."""
    low = F.filter(F.split(F.translate(text, _CAPITALS, _SMALL), ""), lambda c: c != "")
    place = F.transform(low, lambda c: F.coalesce(F.nullif(F.instr(F.lit(CHARACTERS), c), F.lit(0)), F.lit(ALPHABET - 1)))
    return F.concat(F.array_repeat(F.lit(0), ORDER), place)


def _cells(codes: Column) -> Column:
    """For each character the number of its (context, character) cell; none for an empty text."""
    a, last = ALPHABET, F.size(codes) - 1
    cells = F.transform(F.sequence(F.lit(ORDER), last), lambda i: (F.get(codes, i - 2) * a + F.get(codes, i - 1)) * a + F.get(codes, i))
    return F.when(last >= ORDER, cells).otherwise(F.array().cast("array<int>"))


# Witten-Bell blending of orders 0, 1 and 2 over a uniform base, for both classes side by side:
# P_k = (n(context, c) + d(context) * P_{k-1}) / (n(context) + d(context)), d: different characters after the context.
_TABLE = """
WITH counted AS (
  SELECT cell, count_if(verdict = 'allow') AS na, count_if(verdict = 'block') AS nb
  FROM (SELECT verdict, explode_outer(cells) AS cell FROM {labelled}) WHERE cell IS NOT NULL GROUP BY cell
), n2 AS (
  SELECT g.id AS cell, g.id % {a} AS c, g.id DIV {a} AS ctx, (g.id DIV {a}) % {a} AS near, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb
  FROM {grid} AS g LEFT JOIN counted ON g.id = counted.cell
), n1 AS (
  SELECT near, c, sum(na) AS na, sum(nb) AS nb FROM n2 GROUP BY near, c
), n0 AS (
  SELECT c, sum(na) AS na, sum(nb) AS nb FROM n1 GROUP BY c
), t2 AS (
  SELECT ctx, sum(na) AS ta, count_if(na > 0) AS da, sum(nb) AS tb, count_if(nb > 0) AS db FROM n2 GROUP BY ctx
), t1 AS (
  SELECT near, sum(na) AS ta, count_if(na > 0) AS da, sum(nb) AS tb, count_if(nb > 0) AS db FROM n1 GROUP BY near
), t0 AS (
  SELECT c, na, nb, sum(na) OVER () AS ta, sum(CASE WHEN na > 0 THEN 1 ELSE 0 END) OVER () AS da,
         sum(nb) OVER () AS tb, sum(CASE WHEN nb > 0 THEN 1 ELSE 0 END) OVER () AS db FROM n0
), p0 AS (
  SELECT c, CASE WHEN ta > 0 THEN (na + da * (1D / {a})) / (ta + da) ELSE 1D / {a} END AS pa,
         CASE WHEN tb > 0 THEN (nb + db * (1D / {a})) / (tb + db) ELSE 1D / {a} END AS pb FROM t0
), p1 AS (
  SELECT n1.near, n1.c, CASE WHEN ta > 0 THEN (na + da * pa) / (ta + da) ELSE pa END AS pa,
         CASE WHEN tb > 0 THEN (nb + db * pb) / (tb + db) ELSE pb END AS pb
  FROM n1 JOIN t1 ON n1.near = t1.near JOIN p0 ON n1.c = p0.c
), p2 AS (
  SELECT n2.cell, CASE WHEN ta > 0 THEN (na + da * pa) / (ta + da) ELSE pa END AS pa,
         CASE WHEN tb > 0 THEN (nb + db * pb) / (tb + db) ELSE pb END AS pb
  FROM n2 JOIN t2 ON n2.ctx = t2.ctx JOIN p1 ON n2.near = p1.near AND n2.c = p1.c
)
SELECT cell, CAST(round((ln(pa) - ln(pb)) * {unit}) AS BIGINT) AS diff FROM p2
"""


def log_ratio_table(labelled: DataFrame) -> DataFrame:
    """(cell, diff) for all ALPHABET**3 cells: log P(c | context, allow) - log P(c | context, block) in 1/UNIT nats.

    labelled has the columns verdict and cells.
    """
    spark = labelled.sparkSession
    return spark.sql(_TABLE, labelled=labelled, grid=spark.range(ALPHABET**3), a=ALPHABET, unit=UNIT)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null url, or one without `://`, has an empty host and path and no rule;
    its characters (none, if null: score 0) are judged by the model.  A class
    without rule-labelled URLs is uniform; without either class the cut is 0.
    A URL at the cut is allowed.  Extra columns are ignored; repeated rows
    count each.  No rows give no rows.
    """
    rows = _hosts_and_paths(pages)
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("codes", _codes(F.col("url")))  # a column of its own: computed once a row, not once a character
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _cells(F.col("codes")).alias("cells"))
    labelled = rows.where("ruled is not null").select(F.col("ruled").alias("verdict"), "cells")
    table = log_ratio_table(labelled)
    # One array of fixed size, put into each row's expression as a scalar.
    diffs = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "diff"))), lambda x: x["diff"]).alias("diffs")).scalar()
    scored = lambda df: df.withColumn("_t", diffs).withColumn(
        "score", F.when(F.size("cells") > 0, F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + F.get("_t", x)) / F.size("cells")).otherwise(0.0)
    )
    means = scored(labelled).agg(F.avg(F.when(F.col("verdict") == "allow", F.col("score"))).alias("a"), F.avg(F.when(F.col("verdict") == "block", F.col("score"))).alias("b"))
    cut = means.select(F.coalesce((F.col("a") + F.col("b")) / 2, F.lit(0.0)).alias("cut")).scalar()
    by_model = F.when(F.col("score") >= F.col("_cut"), "allow").otherwise("block")
    return scored(rows).withColumn("_cut", cut).select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"))
