"""Joins, opportunities, gates, jobs and lineage on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import analysis, assurance, integrity

from ._tables import table


@query("""
SELECT 'customer.nation' AS relation, c_custkey AS key FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
UNION ALL SELECT 'orders.customer', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'lineitem.part', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)
""")
def fk_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nation, customer, part = t("nation").where("n_regionkey <> 2"), t("customer").where("c_mktsegment <> 'BUILDING'"), t("part").where("p_size < 45")
    lines = t("lineitem").withColumn("line_key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    a = integrity.foreign_key_violations(t("customer"), "c_custkey", ["c_nationkey"], nation, ["n_nationkey"], "customer.nation")
    b = integrity.foreign_key_violations(t("orders"), "o_orderkey", ["o_custkey"], customer, ["c_custkey"], "orders.customer")
    return a.union(b).union(integrity.foreign_key_violations(lines, "line_key", ["l_partkey"], part, ["p_partkey"], "lineitem.part"))


@query("SELECT o_custkey, CAST(floor(o_totalprice / 100000) AS BIGINT) AS bucket, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_identities(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 100000).cast("long").alias("bucket"))
    return integrity.duplicates(rows, ["o_custkey", "bucket"])


_OPPORTUNITIES = """
WITH a AS (
  SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS m, CASE WHEN event_type <> 'error' THEN CAST(round(value) AS BIGINT) ELSE 0 END AS s, event_type <> 'error' AS e FROM events
), g AS (
  SELECT user_id, CAST(sum(m) AS BIGINT) AS missed_optimization_count, bool_or(e) AS runtime_evidence_present, CAST(sum(s) AS BIGINT) AS runtime_sample_count FROM a GROUP BY user_id
)
SELECT *, row_number() OVER (ORDER BY runtime_evidence_present DESC, runtime_sample_count DESC, missed_optimization_count DESC, user_id) AS rank FROM g
"""


@query(_OPPORTUNITIES)
def opportunities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    missed = e.where("event_type = 'error'").select("user_id")
    runtime = e.where("event_type <> 'error'").select("user_id", F.round("value").cast("long").alias("samples"))
    return analysis.opportunities(missed, runtime, "user_id", "samples")


@query("""
SELECT n_nationkey, r_regionkey, (n_nationkey & 7) & (r_regionkey + 1) <> 0 AS allowed, (n_nationkey & (r_regionkey + 1)) = r_regionkey + 1 AS covered
FROM nation, region WHERE n_regionkey <> r_regionkey AND (n_nationkey + r_regionkey) % 3 <> 0
""")
def compatible_pairs(spark, sf_dir):
    """A nation's kind is the bit of its region; a region takes all kinds but its own."""
    nation = table(spark, sf_dir, "nation").withColumn("kind", F.expr("shiftleft(1L, n_regionkey)"))
    region = table(spark, sf_dir, "region").withColumn("takes", F.lit(31).cast("long").bitwiseXOR(F.expr("shiftleft(1L, r_regionkey)")))
    existing = nation.withColumn("_m", F.pmod(-F.col("n_nationkey"), F.lit(3))).join(region, F.col("_m") == F.col("r_regionkey") % 3).select("n_nationkey", "r_regionkey")
    pairs = integrity.pairs_by_mask(nation, "kind", region, "takes", existing, ["n_nationkey", "r_regionkey"])
    mask = F.col("r_regionkey") + 1
    return pairs.select("n_nationkey", "r_regionkey", analysis.mask_allows(F.col("n_nationkey").bitwiseAND(F.lit(7)), mask).alias("allowed"), analysis.mask_covers(F.col("n_nationkey"), mask).alias("covered"))


@query("""
WITH p AS (SELECT n_nationkey, r_regionkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY r_regionkey) - 1 AS k, count(*) OVER (PARTITION BY n_nationkey) AS pair_count
           FROM nation, region WHERE n_regionkey <> r_regionkey AND (n_nationkey + r_regionkey) % 3 <> 0)
SELECT n_nationkey, r_regionkey, pair_count FROM p WHERE k = (n_nationkey * 31 + 5) % pair_count
""")
def kth_pair(spark, sf_dir):
    from lodestone.operators.ranking import kth_row

    return kth_row(compatible_pairs(spark, sf_dir), "n_nationkey", ["r_regionkey"], F.col("n_nationkey") * 31 + 5).select("n_nationkey", "r_regionkey", "pair_count")


@query("""
WITH have AS (SELECT p_type AS have FROM part WHERE p_size <= 3), needs AS (SELECT DISTINCT p_brand AS owner, p_type AS want FROM part WHERE p_size BETWEEN 4 AND 6),
forbids AS (SELECT DISTINCT p_brand AS owner, p_type AS want FROM part WHERE p_size = 7), n AS (SELECT have, count(*) AS c FROM have GROUP BY have)
SELECT owner, want, coalesce(c, 0) AS matches, CASE WHEN c IS NULL THEN 'missing' WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM needs LEFT JOIN n ON want = have
UNION ALL SELECT owner, want, c, 'conflict' FROM forbids JOIN n ON want = have
""")
def dependency_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pick = lambda where: p.where(where).select(F.col("p_brand").alias("owner"), F.col("p_type").alias("want")).distinct()
    return integrity.dependency_status(p.where("p_size <= 3").select(F.col("p_type").alias("have")), pick("p_size between 4 and 6"), "owner", "want", "have", pick("p_size = 7"))


_GATES = """
WITH g AS (SELECT user_id, event_id, ts, event_type <> 'error' AS passed, event_type IN ('error', 'purchase') AS required FROM events),
w AS (SELECT *, coalesce(max(CASE WHEN required AND NOT passed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM g),
s AS (SELECT user_id, event_id, required, CASE WHEN stopped = 1 THEN 'not-run' WHEN passed THEN 'passed' ELSE 'failed' END AS state FROM w)
"""


def _states(spark, sf_dir):
    g = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").isin("error", "purchase").alias("required"), (F.col("event_type") != "error").alias("passed"))
    return assurance.gate_sequence(g, "user_id", ["ts", "event_id"], F.col("passed"), F.col("required"))


@query(_GATES + "SELECT user_id, event_id, state FROM s")
def gate_sequence(spark, sf_dir):
    return _states(spark, sf_dir).select("user_id", "event_id", "state")


@query(_GATES + """SELECT user_id, bool_and(NOT required OR state = 'passed') AS performance_eligible, CAST(count_if(state <> 'not-run') AS BIGINT) AS gates_run,
CAST(count_if(state = 'failed') AS BIGINT) AS gates_failed FROM s GROUP BY user_id""")
def assurance_eligibility(spark, sf_dir):
    return assurance.eligibility(_states(spark, sf_dir), "user_id", F.col("required"))


@query("""
SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'unavailable' WHEN event_id % 37 = 0 THEN 'policy-violation' WHEN event_id % 31 = 0 THEN 'cleanup-failure' WHEN event_id % 29 = 0 THEN 'resource-limit'
       WHEN event_id % 23 = 0 THEN 'timeout' WHEN event_id % 19 = 0 THEN 'signaled' WHEN event_id % 7 <> 0 THEN 'failed' ELSE 'passed' END AS disposition,
       (CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) <= 1
       AND (NOT (event_id % 29 = 0 OR event_id % 23 = 0 OR event_id % 19 = 0) OR event_id % 7 = 0) AND user_id <= 100 AS consistent
FROM events
""")
def gate_dispositions(spark, sf_dir):
    i = F.col("event_id")
    flag = lambda n: i % n == 0
    return table(spark, sf_dir, "events").select(
        "event_id",
        assurance.gate_disposition(flag(41), flag(37), flag(31), flag(29), flag(23), flag(19), i % 7).alias("disposition"),
        assurance.outcome_consistent([flag(29), flag(23), flag(19)], i % 7, F.col("user_id"), 100).alias("consistent"),
    )


@query("""
WITH j AS (
  SELECT CAST(o_custkey AS BIGINT) AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS index, o_orderkey,
         CASE WHEN o_orderkey % 101 = 0 THEN 'timeout' WHEN o_orderkey % 13 = 0 THEN 'candidate-rejected' ELSE 'success' END AS terminal FROM orders
), h AS (
  SELECT *, index // 4 AS wave, min(CASE WHEN terminal = 'timeout' THEN index // 4 END) OVER (PARTITION BY run) AS fw, min(CASE WHEN terminal = 'timeout' THEN index END) OVER (PARTITION BY run) AS fi FROM j
)
SELECT run, index, o_orderkey, terminal, CAST(wave AS BIGINT) AS wave,
       CASE WHEN fw IS NULL THEN 'committed' WHEN wave > fw THEN 'not-started' WHEN wave < fw THEN 'discarded' WHEN terminal = 'timeout' THEN 'failed' ELSE 'canceled' END AS state FROM h
""")
def job_waves(spark, sf_dir):
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("index"), "o_orderkey",
        F.when(k % 101 == 0, "timeout").when(k % 13 == 0, "candidate-rejected").otherwise("success").alias("terminal"),
    )
    return assurance.job_waves(jobs, "run", "index", "terminal", 4)


@query("""
WITH j AS (SELECT c_nationkey AS run, c_custkey AS index, c_acctbal >= 0 AS valid, c_custkey % 211 = 0 AS failed FROM customer)
SELECT run, count(*) AS validated, CAST(count_if(NOT valid) AS BIGINT) AS invalid, CAST(count_if(valid) AS BIGINT) AS scheduled, CAST(count_if(valid AND failed) AS BIGINT) AS failed,
       CAST(CASE WHEN count_if(valid AND failed) = 0 THEN count_if(valid) ELSE 0 END AS BIGINT) AS committed, coalesce(min(CASE WHEN valid AND failed THEN index END), -1) AS first_failure FROM j GROUP BY run
""")
def schedule_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("index"), "c_acctbal")
    return assurance.schedule_counters(rows, "run", F.col("c_acctbal") >= 0, F.col("index") % 211 == 0)


@query("""
WITH e AS (SELECT event_id, event_type, user_id, event_id // 40 AS generation, event_id % 40 // 2 AS slot FROM events)
SELECT CAST(generation AS BIGINT) AS generation, CAST(slot AS BIGINT) AS slot, min(event_id) AS birth_ordinal, max_by(event_type, event_id) AS last_kind, count(*) AS events, min_by(user_id, event_id) AS user_id
FROM e GROUP BY generation, slot
""")
def lineage_bind(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.expr("event_id div 40").alias("generation"), F.expr("event_id % 40 div 2").alias("slot"))
    return integrity.bind_first(e, ["generation", "slot"], "event_id", "event_type", ["user_id"])


@query("SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS total FROM orders ORDER BY floor(o_totalprice / 1000) DESC, o_orderdate, o_orderkey LIMIT 1")
def winner_row(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("total"))
    return integrity.winner_row(rows, ["o_orderdate", "o_orderkey"], "total").select("o_orderkey", "total")


@query("""
WITH a AS (SELECT c_custkey AS key, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.c_mktsegment <> b.c_mktsegment OR a.c_nationkey <> b.c_nationkey
""")
def snapshot_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment", "c_nationkey")
    b = c.where("key % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("key") % 11 == 0, "X").otherwise(F.col("c_mktsegment")))
    return integrity.set_difference(c.where("key % 5 <> 0"), b, "key", ["c_mktsegment", "c_nationkey"])


@query("""
WITH e AS (SELECT source AS path, doc_id AS identity, doc_id * 37 % 9973 AS s, doc_id * 37 % 9973 + n_chars % 200 AS t FROM documents)
SELECT path, identity, CAST(row_number() OVER (PARTITION BY path ORDER BY s, identity) - 1 AS BIGINT) AS position,
       coalesce(max(t) OVER (PARTITION BY path ORDER BY s, identity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s, false) AS overlaps FROM e
""")
def edit_overlap(spark, sf_dir):
    s = F.col("doc_id") * 37 % 9973
    e = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("identity"), s.alias("s"), (s + F.col("n_chars") % 200).alias("t"))
    return integrity.overlapping_edits(e, "path", "s", "t", "identity").select("path", "identity", "position", "overlaps")


@query("""
SELECT l_orderkey, l_linenumber, l_linenumber >= 1 AND l_partkey >= 1 AND (l_linenumber + CAST(l_quantity AS BIGINT) % 2 > l_linenumber
       OR (l_linenumber + CAST(l_quantity AS BIGINT) % 2 = l_linenumber AND l_suppkey >= l_partkey)) AS range_valid FROM lineitem
""")
def source_ranges(spark, sf_dir):
    line = F.col("l_linenumber")
    ok = analysis.range_valid(line, F.col("l_partkey"), line + F.col("l_quantity").cast("long") % 2, F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("range_valid"))


_KINDS = "CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'analysis-failure' WHEN 'error' THEN 'correctness-failure' WHEN 'signup' THEN 'replay-mismatch' ELSE 'unheard-of' END"


@query(f"""
SELECT event_id, {_KINDS} AS terminal, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 20 WHEN 'error' THEN 12 WHEN 'signup' THEN 24 ELSE 1 END AS BIGINT) AS exit_code
FROM events
""")
def exit_codes(spark, sf_dir):
    t = F.expr(_KINDS)
    return table(spark, sf_dir, "events").select("event_id", t.alias("terminal"), assurance.exit_code(t).alias("exit_code"))
