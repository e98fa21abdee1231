"""Fingerprints of baselines, analyses, build descriptions, policies, measurements, assurance, manifests and selectors."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.functions import canonical
from lodestone.functions.fingerprint import text_form
from lodestone.operators import analysis as rules
from lodestone.operators import identity
from lodestone.sources import project

from ._sql import concat, fnv, number, text
from ._tables import table
from .storage import MANIFEST


def _tag(stage: str) -> str:
    return text(f"'{identity.TAGS[stage]}'")


def real(x: str) -> str:
    return text(f"printf('%.17g', CAST({x} AS DOUBLE))")


def flag(x: str) -> str:
    return number(f"CASE WHEN {x} THEN 1 ELSE 0 END")


def _rows(source: str, key: str, order: str, record: str) -> str:
    """A CTE body: k, n and the joined records b of each key."""
    return f"SELECT {key} AS k, count(*) AS n, flatten(list({record} ORDER BY {order})) AS b FROM {source} GROUP BY {key}"


_COUNTED = concat(number("coalesce(n, 0)"), "coalesce(b, [])")


@query(f"""
WITH f AS (SELECT s_nationkey, 's/' || s_suppkey AS path, CAST(s_suppkey * 31 AS BIGINT) AS size, CAST(s_suppkey * 7919 AS BIGINT) AS content FROM supplier),
r AS ({_rows("f", "s_nationkey", "path", concat(text("path"), number("size"), number("420"), number("content")))})
SELECT n_nationkey, {fnv(concat(_tag("baseline"), number("n_nationkey * 1000003"), text("n_name"), _COUNTED, number("n_nationkey + 17")))} AS fingerprint FROM nation LEFT JOIN r ON k = n_nationkey
""")
def file_set_fingerprints(spark, sf_dir):
    key = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("s/"), key).alias("path"), (key * 31).alias("size"), F.lit(420).alias("mode"), (key * 7919).alias("content_fingerprint"))
    n = F.col("n_nationkey").cast("long")
    heads = table(spark, sf_dir, "nation").select("n_nationkey", (n * 1000003).alias("manifest_fingerprint"), F.col("n_name").alias("provider"), (n + 17).alias("build_fingerprint"))
    return identity.file_set(heads, files, "n_nationkey")


@query(f"""
WITH r AS ({_rows("orders", "o_orderstatus", "o_orderkey", concat(number("o_orderkey"), number("o_custkey"), text("o_orderpriority")))})
SELECT k AS o_orderstatus, {fnv(concat(text("'orders.v1'"), _COUNTED))} AS fingerprint FROM r
""")
def table_fingerprints(spark, sf_dir):
    """Documents of half the orders each: their bytes are summarised by all tasks, wherever they lie."""
    orders = table(spark, sf_dir, "orders")
    heads = orders.select("o_orderstatus").distinct().withColumn("head", canonical.text(F.lit("orders.v1")))
    return canonical.fingerprints(heads, "o_orderstatus", [canonical.rows(orders, "o_orderstatus", ["o_orderkey"], identity.record("o_orderkey:number", "o_custkey:number", "o_orderpriority"))])


@query("""
WITH chunks AS (
  SELECT c_nationkey, c_custkey, list_transform(range(1, strlen(c_name) + 1), lambda i: CAST(ascii(c_name[i]) AS BIGINT)) AS bytes FROM customer
), whole AS (
  SELECT c_nationkey, flatten(list(bytes ORDER BY c_custkey)) AS bytes FROM chunks GROUP BY c_nationkey
), steps AS (
  SELECT c_nationkey, len(bytes) AS size, list_prepend(4294967295, flatten(list_transform(bytes, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM whole
)
SELECT c_nationkey, size, xor(4294967295, list_reduce(steps, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc32 FROM steps
""")
def payload_checksums(spark, sf_dir):
    """CRC-32 of payloads whose chunks lie in many tasks."""
    return canonical.checksums(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], F.encode("c_name", "utf-8"))


_NONE = number("0")


@query(f"""
WITH u AS ({_rows("nation", "n_regionkey", "n_name", text("n_name || '.c'"))}),
l AS ({_rows("nation", "n_regionkey", "'loc:' || n_nationkey", concat(text("'loc:' || n_nationkey"), text("n_name || '.c'"), *(number(x) for x in ("n_nationkey + 1", "1", "n_nationkey + 2", "5", "1")), text("''")))}),
s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS ({_rows("s", "n_regionkey", "'d:' || s_suppkey", concat(text("'d:' || s_suppkey"), text("s_name"), text("n_name || '.c'"), text("'loc:' || n_nationkey"), number("1"), number("2"), flag("s_suppkey % 2 = 0")))}),
o AS (SELECT n_regionkey, 'loc:' || n_nationkey AS loc, count(*) AS missed, row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*) DESC, 'loc:' || n_nationkey) AS rank FROM s GROUP BY n_regionkey, n_nationkey),
p AS ({_rows("o", "n_regionkey", "rank", concat(number("rank"), text("loc"), number("missed"), number("0"), number("0")))})
SELECT r_regionkey, {fnv(concat(_tag("analysis"), text("r_name"), *(text(f"'{x}'") for x in ("provider", "compiler", "backend", "target", "flags")), number("1"), text("''"),
    *(concat(number(f"coalesce({t}.n, 0)"), f"coalesce({t}.b, [])") for t in "uld"), _NONE, _NONE, _NONE, _NONE, _NONE, concat(number("coalesce(p.n, 0)"), "coalesce(p.b, [])")))} AS fingerprint
FROM region LEFT JOIN u ON u.k = r_regionkey LEFT JOIN l ON l.k = r_regionkey LEFT JOIN d ON d.k = r_regionkey LEFT JOIN p ON p.k = r_regionkey
""")
def analysis_fingerprints(spark, sf_dir):
    """One analysis for each region: nations are units and locations, suppliers declarations and missed remarks."""
    nation = table(spark, sf_dir, "nation").withColumn("r_regionkey", F.col("n_regionkey")).withColumn("place", F.concat(F.lit("loc:"), "n_nationkey")).withColumn("file", F.concat("n_name", F.lit(".c")))
    both = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("n_nationkey")
    missed = both.groupBy("r_regionkey", F.col("place").alias("location")).agg(F.count(F.lit(1)).alias("missed_optimization_count"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("r_regionkey").orderBy(F.desc("missed_optimization_count"), "location"))
    none = F.lit(None).cast("string")
    tables = {
        "translation_units": nation.select("r_regionkey", "file"),
        "source_locations": nation.select("r_regionkey", F.col("place").alias("identity"), "file", (n + 1).alias("line"), F.lit(1).alias("column"), (n + 2).alias("end_line"), F.lit(5).alias("end_column"), F.lit(1).alias("kind"), none.alias("spelling")),
        "declarations": both.select("r_regionkey", F.concat(F.lit("d:"), "s_suppkey").alias("identity"), F.col("s_name").alias("name"), F.col("file").alias("unit"), F.col("place").alias("location"), F.lit(1).alias("kind"), F.lit(2).alias("linkage"), (F.col("s_suppkey") % 2 == 0).alias("definition")),
        "opportunities": missed.withColumn("rank", rank).withColumn("runtime_evidence_present", F.lit(False)).withColumn("runtime_sample_count", F.lit(0)),
    }
    words = [F.lit(x).alias(x) for x in ("provider", "compiler", "backend", "target", "flags")]
    heads = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("baseline_fingerprint"), *words, F.lit(1).alias("runtime_state"), none.alias("runtime_profile"))
    return identity.analysis(heads, tables, "r_regionkey")


@query("""
WITH n AS (SELECT n_regionkey AS k, count(*) AS c FROM nation GROUP BY 1), s AS (SELECT n_regionkey AS k, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
e AS (SELECT n_regionkey AS k, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY 1)
SELECT r_regionkey, r_name AS baseline_fingerprint, coalesce(n.c, 0) AS n_source_locations, coalesce(n.c, 0) AS n_translation_units, coalesce(s.c, 0) AS n_declarations, coalesce(e.c, 0) AS n_calls, true AS projection_complete, false AS probabilistic_authority
FROM region LEFT JOIN n ON n.k = r_regionkey LEFT JOIN s ON s.k = r_regionkey LEFT JOIN e ON e.k = r_regionkey
""")
def analysis_views(spark, sf_dir):
    """What an analysis of each region shows: its head, and how many units, locations, declarations and calls it has."""
    nation = table(spark, sf_dir, "nation").withColumn("r_regionkey", F.col("n_regionkey"))
    of = lambda name, key: table(spark, sf_dir, name).join(nation, F.col(key) == F.col("n_nationkey"))
    tables = {"source_locations": nation, "translation_units": nation, "declarations": of("supplier", "s_nationkey"), "calls": of("customer", "c_nationkey").where("c_acctbal < 0")}
    return rules.published(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("baseline_fingerprint")), tables, "r_regionkey")


@query(f"""
WITH c AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position, p_name, p_type, p_size, p_partkey,
           CASE WHEN p_size % 3 = 0 THEN '' ELSE 'o' || p_partkey END AS output FROM part),
r AS ({_rows("c", "p_brand", "position", f"CASE WHEN p_size % 2 = 0 THEN {concat(text('p_name'), text(chr(39) + '.' + chr(39)), text('output'), number('1'), number('2'), text('p_type'), text('p_name'))} ELSE {concat(text('p_name'), text(chr(39) + '.' + chr(39)), text('output'), number('2'), text('p_type'))} END")})
SELECT k AS p_brand, {fnv(concat(_tag("build"), _COUNTED))} AS fingerprint FROM r
""")
def build_fingerprints(spark, sf_dir):
    from pyspark.sql import Window

    even = F.col("p_size") % 2 == 0
    units = table(spark, sf_dir, "part").select(
        "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("position"), F.col("p_name").alias("file"), F.lit(".").alias("directory"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("o"), "p_partkey")).alias("output"), F.when(even, "arguments").otherwise("command").alias("form"),
        F.when(even, F.array("p_type", "p_name")).alias("arguments"), F.when(~even, F.col("p_type")).alias("command"),
    )
    return identity.build_description(units, "p_brand")


@query(f"SELECT c_custkey, {fnv(concat(_tag('condition'), *(text(f'c_name || {k}') for k in range(len(identity.CONDITION)))))} AS fingerprint FROM customer")
def condition_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[F.concat("c_name", F.lit(str(k))).alias(c) for k, c in enumerate(identity.CONDITION)])
    return identity.condition(rows, "c_custkey")


_WHOLE = [f.partition(":")[0] for f in identity.POLICY if f.endswith(":number")]


@query(f"""
WITH r AS ({_rows("nation", "n_regionkey", "n_nationkey", concat(text("n_name"), *(number(f"n_nationkey + {k}") for k in range(len(_WHOLE))), real("n_nationkey * 0.1::DOUBLE"), real("n_nationkey + 0.5"), real("1.0")))})
SELECT r_regionkey, {fnv(concat(_tag("policy"), text("r_name"), text("'p'"), _COUNTED, *(real(f"r_regionkey * 0.{k + 1}::DOUBLE") for k in range(6))))} AS fingerprint FROM region LEFT JOIN r ON k = r_regionkey
""")
def policy_fingerprints(spark, sf_dir):
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    workloads = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), n.alias("position"), F.col("n_name").alias("workload"), *[(n + k).alias(c) for k, c in enumerate(_WHOLE)], (n * 0.1).alias("weight"), (n + 0.5).alias("memory_weight"), F.lit(1.0).alias("binary_weight"))
    heads = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("policy_id"), F.lit("p").alias("provider"), *[(r * float(f"0.{k + 1}")).alias(w) for k, w in enumerate(identity.WEIGHTS)])
    return identity.policy(heads, workloads, "r_regionkey")


_PRINTS = concat(text("c_name"), number("c_custkey % 2"), number("2"), number("c_custkey % 7"), number("c_custkey"), flag("true"), flag("false"), flag("c_custkey % 5 = 0"), flag("c_custkey % 3 = 0"),
                 text("CASE WHEN c_custkey % 3 = 0 THEN 'condition-mismatch' ELSE '' END"), number("c_custkey * 13"), *(number(f"c_custkey * {k}") for k in (1000, 10, 7)), number("900000"), number("800000"))


@query(f"""
WITH r AS ({_rows("customer", "c_nationkey", "c_custkey", _PRINTS)})
SELECT n_nationkey, {fnv(concat(_tag("measurement"), text("n_name"), text("'a'"), text("'b'"), number("n_nationkey"), number("n_nationkey + 1"), _COUNTED, number("3"), *(real("n_nationkey * 0.25") for _ in range(7)), flag("true")))} AS fingerprint
FROM nation LEFT JOIN r ON k = n_nationkey
""")
def measurement_fingerprints(spark, sf_dir):
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    samples = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("workload"), (c % 2).alias("subject"), F.lit(2).alias("phase"), (c % 7).alias("pair_index"), c.alias("sequence_index"),
        F.lit(True).alias("completed"), F.lit(False).alias("timed_out"), (c % 5 == 0).alias("failed"), (c % 3 == 0).alias("excluded"), F.when(c % 3 == 0, "condition-mismatch").alias("exclusion"),
        (c * 13).alias("condition_fingerprint"), (c * 1000).alias("runtime_ns"), (c * 10).alias("peak_memory"), (c * 7).alias("binary_size"), F.lit(900000).alias("reliability"), F.lit(800000).alias("maintainability"),
    )
    heads = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_name").alias("candidate_fingerprint"), F.lit("a").alias("assurance_fingerprint"), F.lit("b").alias("baseline_identity"), n.alias("policy_fingerprint"),
        (n + 1).alias("condition_fingerprint"), F.lit(3).alias("comparison"), *[(n * 0.25).alias(w) for w in (*identity.WEIGHTS, "total")], F.lit(True).alias("fitness_available"),
    )
    return identity.measurement(heads, samples, "n_nationkey")


_GATE = concat(text("s_name"), text("'profile'"), number("1"), flag("s_suppkey % 2 = 0"), number("s_suppkey % 8"), number("s_suppkey % 3 + 1"), number("0"), *(x for k in (5, 6) for x in (number(f"s_suppkey * {k}"), text(f"'out{k}'"))),
               text("'tools'"), text("CASE WHEN s_suppkey % 4 = 0 THEN 'said' ELSE '' END"), *(flag(x) for x in ("true", "true", "true", "false", "s_suppkey % 50 = 0")))


@query(f"""
WITH r AS ({_rows("supplier", "s_nationkey", "s_suppkey", _GATE)})
SELECT n_nationkey, {fnv(concat(_tag("assurance"), text("n_name"), number("n_nationkey * 11"), text("'p'"), number("1"), _COUNTED, flag("n_nationkey % 2 = 0"), flag("false")))} AS fingerprint FROM nation LEFT JOIN r ON k = n_nationkey
""")
def assurance_fingerprints(spark, sf_dir):
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    gates = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), s.alias("position"), F.col("s_name").alias("gate"), F.lit("profile").alias("profile"), F.lit(1).alias("stage"), (s % 2 == 0).alias("required"),
        (s % 8).alias("disposition"), (s % 3).alias("exit_code"), F.lit(0).alias("signal"), (s * 5).alias("stdout_bytes"), F.lit("out5").alias("stdout_fingerprint"), (s * 6).alias("stderr_bytes"),
        F.lit("out6").alias("stderr_fingerprint"), F.lit("tools").alias("toolchain_fingerprint"), F.when(s % 4 == 0, "said").alias("excerpt"),
        *[F.lit(True).alias(x) for x in ("filesystem_enforced", "network_enforced", "group_clean")], F.lit(False).alias("source_modified"), (s % 50 == 0).alias("snapshot_modified"),
    )
    heads = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("candidate_fingerprint"), (n * 11).alias("policy_fingerprint"), F.lit("p").alias("provider"), F.lit(1).alias("stage"), (n % 2 == 0).alias("performance_eligible"), F.lit(False).alias("champion_eligible"))
    return identity.assurance(heads, gates, "n_nationkey")


def _manifest_sql() -> str:
    m, said = MANIFEST, lambda x: text(f"'{x}'")
    listed = lambda name, values: [said(name), number(str(len(values))), *(said(v) for v in values)]
    s, b = m["source"], m["build"]
    parts = [said("schema"), said(m["schema"]), said("manifest_id"), text("n_name"), said("source_identity"), said(s["declared_identity"]), *listed("permitted_roots", s["permitted_roots"])]
    parts += [said("compilation_database"), said(s["compilation_database"]), said("generated_source_policy"), said(s["generated_source_policy"]), said("build_frontend"), said(b["frontend"])]
    for stage in ("configure", "compile", "correctness", "benchmark"):
        parts += [said(stage), *listed("argv", b[stage])]
    parts += [flag("true"), said("language"), said(m["target"]["language"]), *listed("targets", m["target"]["platforms"])]
    for name, second in (("dependencies", "identity"), ("toolchains", "identity"), ("environment", "value")):
        parts += [said(name), number(str(len(m[name]))), *(x for e in m[name] for x in (said(e["name"]), said(e[second])))]
    parts += [*listed("workloads", m["workloads"]), *listed("constraints", m["constraints"]), said("search"), *(number(str(m["search"][k])) for k in ("seed", "population", "generations", "workers")), said("budgets")]
    parts += [number(str(m["budgets"].get(k, 0))) for k in identity.BUDGETS] + [x for k in ("retention", "cleanup") for x in (said(k), said(m["artifacts"].get(k, "")))]
    return f"SELECT n_nationkey, {fnv(concat(*parts))} AS fingerprint FROM nation"


@query(_manifest_sql())
def manifest_fingerprints(spark, sf_dir):
    """Manifests that differ in their identity; half of them with their keys in another order."""
    straight, turned = json.dumps(MANIFEST), json.dumps(dict(reversed(MANIFEST.items())))
    value = F.when(F.col("n_nationkey") % 2 == 0, F.lit(straight)).otherwise(F.lit(turned))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.replace(value, F.lit('"manifest_id": "x"'), F.concat(F.lit('"manifest_id": "'), "n_name", F.lit('"'))).alias("value"))
    return project.parse_manifests(rows, "value", "m.v1").select("n_nationkey", identity.manifest(F.col("manifest")).alias("fingerprint"))


@query(f"SELECT c_custkey, {fnv(concat(_tag('selector'), text(chr(39) + 'initialize' + chr(39)), number('42'), number('c_custkey'), text(chr(39) + 'p' + chr(39)), 'list_transform(range(1, strlen(c_name) + 1), lambda i: CAST(ascii(c_name[i]) AS BIGINT))'))} AS selector FROM customer")
def search_selectors(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", identity.selector(F.lit("initialize"), F.lit(42), c, F.lit("p"), F.encode("c_name", "utf-8")).alias("selector"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS current FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 <> 0")
def fingerprint_currency(spark, sf_dir):
    """Stated fingerprints against those computed now: some are old, some documents went."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(text_form(0)), "c_custkey").alias("fingerprint"))
    now = c.where("c_custkey % 5 <> 0 or c_custkey % 3 <> 0").withColumn("fingerprint", F.when(F.col("c_custkey") % 3 == 0, "old").otherwise(F.col("fingerprint")))
    return rules.is_current(c.where("c_custkey % 5 <> 0 or c_custkey % 3 <> 0"), now, "c_custkey")
