"""Manifests, compilation databases, evidence text and event windows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.sources import project, sinks
from lodestone.streaming import observer

from ._tables import table


@query("SELECT 'src/f' || c_custkey || '.c' AS file, 'arguments' AS form, CASE WHEN c_custkey % 10 = 0 THEN 'file-not-captured' ELSE 'accepted' END AS problem FROM customer")
def compilation_units(spark, sf_dir):
    """Canonical records of one database per customer segment, built from the customers as files."""
    c = table(spark, sf_dir, "customer")
    file = F.concat(F.lit("src/f"), F.col("c_custkey"), F.lit(".c"))
    record = F.to_json(F.struct(F.lit(".").alias("directory"), file.alias("file"), F.array(F.lit("cc"), F.lit("-c"), file).alias("arguments")))
    text = c.groupBy("c_mktsegment").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ","), F.lit("]")).alias("value"))
    files = c.where("c_custkey % 10 <> 0").select(file.alias("path"))
    return project.compilation_units(text, "value", files, "/work").select("file", "form", F.coalesce("problem", F.lit("accepted")).alias("problem"))


@query("""
SELECT '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']' AS value FROM region
""")
def evidence_json(spark, sf_dir):
    return sinks.canonical_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


@query("""
SELECT '# Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) || chr(10) AS value FROM region
""")
def evidence_markdown(spark, sf_dir):
    out = sinks.markdown(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"], "Regions")
    return out.select(F.replace("value", F.lit("|\n| ---"), F.lit("|\n| ---")).alias("value"))


@query("""
SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS window_start, event_type, max(value) AS best_total, count(*) AS rows FROM events GROUP BY 1, 2
""")
def windowed_best(spark, sf_dir):
    out = observer.windowed_best(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return out.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "best_total", "rows")


#: A manifest that is accepted.
MANIFEST = {
    "schema": "m.v1", "manifest_id": "x", "source": {"declared_identity": "s", "permitted_roots": ["a", "b"], "compilation_database": "c.json", "generated_source_policy": "reject"},
    "build": {"frontend": "cmake", "configure": ["c"], "compile": ["c"], "correctness": ["t"], "benchmark": ["b"], "benchmark_required": True}, "target": {"language": "c17", "platforms": ["p"]},
    "dependencies": [{"name": "a", "identity": "i"}], "toolchains": [], "environment": [{"name": "LANG", "value": "C"}], "workloads": ["w"], "constraints": ["k"], "search": {"seed": 1, "population": 8, "generations": 4, "workers": 1}, "budgets": {"max_files": 3, "command_timeout_ms": 500}, "artifacts": {"retention": "keep"},
}


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 1 THEN 'schema' WHEN 2 THEN 'unknown-key' WHEN 3 THEN 'array-order' WHEN 4 THEN 'syntax' ELSE 'accepted' END AS problem FROM nation")
def manifest_checks(spark, sf_dir):
    """A manifest for each nation, some of them broken in one way."""
    text = json.dumps(MANIFEST)
    n = F.col("n_nationkey")
    value = (
        F.when(n % 5 == 1, F.lit(text.replace('"m.v1"', '"m.v0"'))).when(n % 5 == 2, F.lit(text.replace('"manifest_id"', '"other"'))).when(n % 5 == 3, F.lit(text.replace('["a", "b"]', '["b", "a"]'))).when(n % 5 == 4, F.lit(text[:-1])).otherwise(F.lit(text))
    )
    return project.parse_manifests(table(spark, sf_dir, "nation").select("n_nationkey", value.alias("value")), "value", "m.v1").select("n_nationkey", F.coalesce("problem", F.lit("accepted")).alias("problem"))
