"""Recorded outcomes, snapshots, jobs, checkpoints, documents, lineage and candidates on the driver tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import assurance, identity, rewrites
from lodestone.plans import search, stages
from lodestone.sources import container, documents, product, recorded

from ._sql import ascii_bytes, concat, fnv, fnv_value, number, text, unsigned
from ._tables import table

_STAGE = "CASE event_id % 5 WHEN 0 THEN 'configure' WHEN 1 THEN 'compile' WHEN 2 THEN 'correctness' WHEN 3 THEN 'benchmark' ELSE 'other' END"


def _outcomes(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i, F.expr("event_id div 5").cast("string").alias("subject"), F.expr(_STAGE).alias("stage"), (i % 23 == 0).alias("timed_out"), F.when(i % 19 == 0, 300).when(i % 7 == 0, 1).otherwise(0).cast("long").alias("exit_code"),
        (F.col("user_id") * 10).alias("output_bytes"), i.alias("output_fingerprint"),
    )


_CODE = "CASE WHEN event_id % 19 = 0 THEN 300 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END"


@query(f"""
SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'timeout' WHEN {_CODE} <> 0 THEN 'failed' ELSE 'passed' END AS disposition, 'fnv1a64-v1:' || printf('%016x', event_id) AS output,
       CASE WHEN event_id % 5 = 4 THEN 'stage' WHEN {_CODE} > 255 OR (event_id % 23 = 0 AND {_CODE} <> 0) THEN 'exit-code' WHEN user_id * 10 > 1000 THEN 'output' ELSE 'sound' END AS problem FROM events
""")
def command_outcomes(spark, sf_dir):
    out = recorded.command_outcomes(_outcomes(spark, sf_dir), 1000)
    return out.select("event_id", "disposition", "output", F.coalesce("problem", F.lit("sound")).alias("problem"))


@query(f"""
WITH e AS (SELECT event_id // 5 AS s, event_id % 5 AS k, event_id % 23 <> 0 AND {_CODE} = 0 AS passed FROM events WHERE event_id % 5 <> 4),
g AS (SELECT s, coalesce(bool_or(passed AND k = 0), false) AS c, coalesce(bool_or(passed AND k = 1), false) AS m, coalesce(bool_or(passed AND k = 2), false) AS t, coalesce(bool_or(passed AND k = 3), false) OR s % 2 = 0 AS b FROM e GROUP BY s)
SELECT CAST(s AS VARCHAR) AS subject, CASE WHEN NOT c OR NOT m THEN 'build-failed' WHEN NOT t THEN 'correctness-failed' WHEN NOT b THEN 'benchmark-ineligible' ELSE 'eligible' END AS state,
       CAST(1 + CASE WHEN c THEN 1 + CASE WHEN m THEN 1 + CASE WHEN t THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END AS BIGINT) AS stages_run FROM g
""")
def baseline_stages(spark, sf_dir):
    rows = recorded.command_outcomes(_outcomes(spark, sf_dir), 1 << 30).where("stage <> 'other'")
    return recorded.baseline_states(rows, F.col("subject").cast("long") % 2 != 0)


@query("""
WITH r AS (SELECT p_brand AS workload, min_by(p_name, p_partkey) AS command FROM part WHERE p_size > 30 GROUP BY p_brand)
SELECT p_partkey, coalesce(command, 'unknown') AS command FROM part LEFT JOIN r ON p_brand = workload
""")
def workload_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    registry = p.where("p_size > 30").select(F.col("p_brand").alias("workload"), F.col("p_partkey").alias("position"), F.col("p_name").alias("command"))
    return recorded.workload_of(p.select("p_partkey", "p_brand"), "p_brand", registry).select("p_partkey", F.coalesce("command", F.lit("unknown")).alias("command"))


@query("""
SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'size' ELSE 'content' END AS problem FROM documents
WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0 OR doc_id % 7 <> 0 AND doc_id % 11 = 0 OR doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND (doc_id % 5 = 0 OR doc_id % 13 = 0 AND length(text) > 0)
""")
def snapshot_files(spark, sf_dir):
    """Documents as files against their records: some went, some came, some grew, some changed a byte."""
    k = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(k, F.concat(F.lit("d"), k).alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    records = recorded.file_records(files.where("doc_id % 11 <> 0"))
    byte = F.unhex(F.lit("01"))
    content = F.when(k % 5 == 0, F.concat("content", byte)).when((k % 13 == 0) & (F.octet_length("content") > 0), F.concat(byte, F.expr("substring(content, 2)"))).otherwise(F.col("content"))
    return recorded.file_problems(files.where("doc_id % 7 <> 0").select("path", content.alias("content")), records)


@query("""
WITH g AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS round, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'purchase' THEN 'success' ELSE 'none' END AS reason,
           event_type IN ('error', 'signup') OR (event_type = 'purchase' AND event_id % 2 = 0) AS terminal FROM events),
f AS (SELECT user_id, min_by(CASE WHEN terminal AND reason <> 'none' THEN reason ELSE 'provider-protocol' END, round) AS t FROM g WHERE round < 3 AND (terminal OR reason <> 'none') GROUP BY user_id)
SELECT u.user_id, coalesce(t, 'provider-protocol') AS terminal FROM (SELECT DISTINCT user_id FROM events) AS u LEFT JOIN f ON u.user_id = f.user_id
""")
def polled_jobs(spark, sf_dir):
    from pyspark.sql import Window

    kind = F.col("event_type")
    reason = F.when(kind == "error", "timeout").when(kind == "purchase", "success").otherwise("none")
    terminal = kind.isin("error", "signup") | ((kind == "purchase") & (F.col("event_id") % 2 == 0))
    polls = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("round"), terminal.alias("terminal"), reason.alias("reason"))
    return assurance.polled_terminal(polls, ["user_id"], 3)


@query("""
WITH j AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'candidate-rejected' WHEN 2 THEN 'timeout' ELSE 'canceled' END AS polled, CASE WHEN o_orderkey % 9 = 0 THEN 'canceled' ELSE 'same' END AS j FROM orders),
r AS (SELECT k, polled, CASE WHEN k % 31 = 0 THEN polled WHEN k % 23 = 0 THEN 'cleanup-failed' WHEN k % 17 = 0 THEN 'capability-unavailable' WHEN j = 'canceled' AND polled <> 'canceled' AND k % 2 = 0 THEN 'provider-protocol'
  WHEN polled = 'success' AND k % 12 = 0 THEN 'provider-protocol' ELSE polled END AS reason FROM j)
SELECT k AS o_orderkey, reason, CASE WHEN k % 31 = 0 THEN 'not-started' WHEN k % 23 = 0 THEN 'cleanup-failed' WHEN reason IN ('success', 'candidate-rejected', 'none') THEN 'staged' ELSE 'joined' END AS state FROM r
""")
def joined_jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    polled = F.when(k % 4 == 0, "success").when(k % 4 == 1, "candidate-rejected").when(k % 4 == 2, "timeout").otherwise("canceled")
    joined = F.when(k % 9 == 0, "canceled").otherwise(polled)
    reason, state = assurance.joined_state(k % 31 != 0, polled, joined, k % 23 != 0, k % 2 == 1, k % 17 != 0, k % 12 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"), state.alias("state"))


@query("""
SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'unavailable' WHEN event_id % 37 = 0 THEN 'policy-violation' WHEN event_id % 11 = 0 THEN 'signaled' WHEN event_id % 7 <> 0 THEN 'failed' ELSE 'passed' END AS disposition,
       'fnv1a64-v1:' || printf('%016x', event_id * 3) AS stdout_fingerprint, CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS excerpt,
       CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'resource-limit' WHEN 'error' THEN 'state' ELSE 'recipe-invalid' END AS rejection,
       CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE event_id % 2 = 0 AND event_id % 5 = 0 END AS available, user_id % 3 <> 0 AND user_id % 3 <> 2 AS identified FROM events
""")
def gate_evidence(spark, sf_dir):
    """Gate records, what recipe statuses mean, whether providers can run, and whether identities are fit to be kept."""
    i, kind = F.col("event_id"), F.col("event_type")
    no = F.lit(False)
    rows = table(spark, sf_dir, "events").select(
        i, kind, "user_id", (i % 41 == 0).alias("unavailable"), (i % 37 == 0).alias("policy_violation"), no.alias("cleanup_failure"), no.alias("resource_limit"), no.alias("timed_out"),
        F.when(i % 11 == 0, 9).otherwise(0).alias("signal"), (i % 7).alias("exit_code"), (i * 3).alias("stdout_fingerprint"), i.alias("stderr_fingerprint"), i.alias("toolchain_fingerprint"),
        F.when(kind == "view", "").otherwise(kind).alias("excerpt"),
    )
    status = F.when(kind == "click", "ok").when(kind == "view", "out-of-memory").when(kind == "error", "state").otherwise("stale-target")
    provider = F.when(i % 3 == 0, "execution").otherwise("analysis")
    name = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 2, F.repeat(F.lit("x"), 64)).otherwise("fine")
    return assurance.gate_records(rows).select(
        "event_id", "disposition", "stdout_fingerprint", F.coalesce("excerpt", F.lit("none")).alias("excerpt"), assurance.recipe_rejection(status).alias("rejection"),
        assurance.provider_available(provider, i % 2 == 0, i % 5 == 0).alias("available"), assurance.identity_valid(name).alias("identified"),
    )


@query("""
WITH j AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, o_orderkey, o_orderkey % 6 <> 0 AS started, CASE WHEN o_orderkey % 6 = 0 THEN 'start-failed' ELSE 'none' END AS terminal, CASE WHEN o_orderkey % 6 = 0 THEN 'terminal' ELSE 'started' END AS state FROM j WHERE i // 4 = 1
""")
def started_wave(spark, sf_dir):
    from pyspark.sql import Window

    jobs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("index"))
    return assurance.started_wave(jobs, "index", 4, 1, F.col("o_orderkey") % 6 == 0).select("o_custkey", "o_orderkey", "started", "terminal", "state")


def _identities(spark, sf_dir):
    k = F.col("c_custkey")
    texts = [F.concat("c_name", F.lit(c)).alias(c) for c in product.TEXTS]
    return table(spark, sf_dir, "customer").select(k, *[F.lit(n + 1).cast("long").alias(c) for n, c in enumerate(product.VERSIONS)], k.alias("seed"), (k % 9).alias("generation"), *texts, F.encode("c_mktsegment", "utf-8").alias("checkpoint"))


@query(f"""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'integrity' WHEN c_custkey % 7 = 0 THEN 'format' WHEN c_custkey % 3 = 0 THEN 'identity-mismatch' ELSE 'valid' END AS problem,
       CAST(80 + strlen(c_mktsegment) + 10 * (8 + strlen(c_name)) + {sum(map(len, product.TEXTS))} AS BIGINT) AS bytes FROM customer
""")
def product_checkpoints(spark, sf_dir):
    """Checkpoints of whole searches: some damaged, some cut, some of another search."""
    # A small file is one task, however long its rows take.
    rows = product.created(_identities(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")).select("c_custkey", "product")
    rows, k = rows.withColumn("bytes", F.octet_length("product").cast("long")), F.col("c_custkey")
    flipped = F.concat(F.expr("substring(product, 1, length(product) - 1)"), F.unhex(F.lit("00")))
    sent = rows.withColumn("sent", F.when(k % 5 == 0, flipped).when(k % 7 == 0, F.expr("substring(product, 1, length(product) - 3)")).otherwise(F.col("product")))
    expected = _identities(spark, sf_dir).withColumn("seed", F.when(k % 3 == 0, F.col("seed") + 1).otherwise(F.col("seed")))
    told = product.validated(sent, "sent", expected, "c_custkey", keep=("bytes",))
    return told.select("c_custkey", F.coalesce("problem", F.lit("valid")).alias("problem"), "bytes")


@query("""
SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS population_index, s_acctbal > 0 AS valid, s_acctbal AS total, printf('%04X', CAST(s_suppkey AS INTEGER)) AS genome FROM supplier
""")
def checkpoint_candidates(spark, sf_dir):
    """Candidates of one binary checkpoint for each nation, written and read again."""
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_acctbal"))).alias("s"))  # one population

    layout, write, names = container.CANDIDATE, container.encode, container.SECTIONS

    def encode(parts):
        for part in parts:
            out = []
            for people in part["s"]:
                told = b"".join(struct.pack(layout, p["s_acctbal"] > 0, p["s_acctbal"] > 0, *[0.0] * 6, p["s_acctbal"]) for p in people)
                sections = dict.fromkeys(names, b"") | {"configuration": b"c", "evaluations": told, "genomes": b"".join(struct.pack(">H", p["s_suppkey"]) for p in people)}
                out.append(write(sections))
            yield pd.DataFrame({"s_nationkey": part["s_nationkey"], "raw": out})

    written = rows.mapInPandas(encode, "s_nationkey int, raw binary")
    out = container.candidates(written, "raw", 2)
    return out.select("s_nationkey", "population_index", "valid", "total", F.hex("genome").alias("genome"))


# --- documents


def _json(value: str, quoted: bool) -> str:
    return f"coalesce('\"' || {value} || '\"', 'null')" if quoted else f"coalesce(CAST({value} AS VARCHAR), 'null')"


def _document_sql(kind: str, heads: str, key: str, relations: dict[str, tuple[str, str]], quoted: set[str]) -> str:
    """SQL of both forms of a document; heads and relations are SELECTs with the fields' names; `quoted` are texts."""
    told, ctes, joins = documents.KINDS[kind], [f"heads AS ({heads})"], ""
    json = [f"'{{\"schema\":\"{told.schema}\"'", *(f"',\"{h}\":' || {_json(h, h in quoted)}" for h in told.head)]
    marks = [f"'# {told.title}' || chr(10) || chr(10) || '- schema: `{told.schema}`' || chr(10)", *(f"'- {h}: `' || coalesce(CAST({h} AS VARCHAR), '') || '`' || chr(10)" for h in told.head)]
    for r in told.relations:
        title = f"chr(10) || '## {r.name.replace('_', ' ').capitalize()}' || chr(10) || chr(10) || "
        if r.name not in relations:
            json.append(f"',\"{r.name}\":[]'")
            marks.append(title + f"'| {' | '.join(r.fields)} |' || chr(10) || '|{' --- |' * len(r.fields)}' || chr(10)")
            continue
        source, names = relations[r.name]
        shown = names.split()
        cells = " || ',' || ".join(f"'\"{f}\":' || {_json(f, f in quoted)}" for f in shown)
        line = " || ' | ' || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in shown)
        ctes.append(f"{r.name} AS (SELECT {key}, string_agg('{{' || {cells} || '}}', ',' ORDER BY {r.order}) AS {r.name}_j, string_agg('| ' || {line} || ' |', chr(10) ORDER BY {r.order}) AS {r.name}_l FROM ({source}) GROUP BY {key})")
        joins += f" LEFT JOIN {r.name} USING ({key})"
        json.append(f"',\"{r.name}\":[' || coalesce({r.name}_j, '') || ']'")
        marks.append(title + f"'| {' | '.join(shown)} |' || chr(10) || '|{' --- |' * len(shown)}' || coalesce(chr(10) || {r.name}_l, '') || chr(10)")
    return f"WITH {', '.join(ctes)} SELECT {key}, {' || '.join(json)} || '}}' AS json, {' || '.join(marks)} AS markdown FROM heads{joins}"


_HEAD = "SELECT n_nationkey, {fields} FROM nation"


def _register(kind: str, head: dict[str, str], relation: str | None, fields: dict[str, str], texts: str) -> None:
    """A query of one kind of document for each nation, its suppliers the rows of one relation.

    Fields are given as expressions that Spark and DuckDB both read.
    """
    select = lambda cols: ", ".join(f"{e} AS {c}" for c, e in cols.items())
    relations = {relation: (f"SELECT s_nationkey AS n_nationkey, {select(fields)} FROM supplier", " ".join(f for f in next(r for r in documents.KINDS[kind].relations if r.name == relation).fields if f in fields))} if relation else {}
    sql = _document_sql(kind, _HEAD.format(fields=select(head)), "n_nationkey", relations, set(texts.split()))

    def run(spark, sf_dir):
        heads = table(spark, sf_dir, "nation").selectExpr("n_nationkey", *[f"{e} AS {c}" for c, e in head.items()])
        rows = {relation: table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS n_nationkey", *[f"{e} AS {c}" for c, e in fields.items()])} if relation else {}
        return documents.documents(kind, heads, rows, "n_nationkey")

    run.__name__ = f"{kind}_document"
    query(sql)(run)


_register("baseline", {"manifest_id": "n_name", "provider": "'p'", "state": "'eligible'", "baseline_fingerprint": "n_name"}, "files", {"path": "s_name", "size": "s_suppkey", "mode": "420", "content_fingerprint": "s_name"}, "manifest_id provider state baseline_fingerprint path content_fingerprint")
_register("analysis", {"baseline_fingerprint": "n_name", "provider": "'p'", "compiler": "'c'", "target": "'t'", "analysis_fingerprint": "n_name"}, "declarations", {"identity": "s_name", "name": "s_name", "unit": "'u.c'", "location": "s_name", "kind": "1", "linkage": "2", "definition": "s_suppkey % 2 = 0"}, "baseline_fingerprint provider compiler target analysis_fingerprint identity name unit location")
_register("catalogue", {"identity": "n_name", "version": "n_nationkey"}, "entries", {"transformation": "s_name", "version": "1", "mask": "s_suppkey % 4"}, "identity transformation")
_register("recipe", {"recipe_fingerprint": "n_name", "catalogue": "'c'", "catalogue_version": "1"}, "records", {"position": "s_suppkey", "identity": "s_name", "transformation": "'t'", "version": "1", "target": "s_name", "file": "'f.c'", "opportunity_rank": "s_suppkey"}, "recipe_fingerprint catalogue identity transformation target file")
_register("application", {"recipe_fingerprint": "n_name", "record": "'r'", "transformation": "'t'", "status": "'edit'"}, "edits", {"path": "s_name", "before_start": "s_suppkey", "before_end": "s_suppkey + 4", "before_fingerprint": "'b'", "after_start": "s_suppkey", "after_end": "s_suppkey + 2", "replacement_fingerprint": "'a'"}, "recipe_fingerprint record transformation status path before_fingerprint replacement_fingerprint")
_register("candidate", {"recipe_fingerprint": "n_name", "baseline_fingerprint": "'b'", "candidate_fingerprint": "'c'"}, "changed_files", {"path": "s_name", "before_size": "s_suppkey", "before_fingerprint": "'b'", "after_size": "s_suppkey + 1", "after_fingerprint": "'a'", "edit_count": "1"}, "recipe_fingerprint baseline_fingerprint candidate_fingerprint path before_fingerprint after_fingerprint")
_register("assurance", {"candidate_fingerprint": "n_name", "stage": "'fast'", "performance_eligible": "n_nationkey % 2 = 0", "champion_eligible": "false"}, "gates", {"position": "s_suppkey", "gate": "s_name", "profile": "'p'", "stage": "'fast'", "required": "s_suppkey % 2 = 0", "disposition": "'passed'", "exit_code": "s_suppkey % 3"}, "candidate_fingerprint stage gate profile disposition")
_register("measurement", {"candidate_fingerprint": "n_name", "comparison": "'faster'", "fitness_available": "true", "total": "n_nationkey"}, "samples", {"workload": "s_name", "subject": "'baseline'", "phase": "'recorded'", "pair_index": "s_suppkey % 5", "sequence_index": "s_suppkey", "runtime_ns": "s_suppkey * 1000", "exclusion": "CASE WHEN s_suppkey % 3 = 0 THEN 'late' END"}, "candidate_fingerprint comparison workload subject phase exclusion")
_register("search", {"seed": "n_nationkey", "generations": "3", "reason": "'converged'", "best_recipe": "n_name", "best_total": "n_nationkey"}, "events", {"ordinal": "s_suppkey", "generation": "0", "population_index": "s_suppkey", "step": "0", "kind": "'add'", "parent_a": "s_name", "result": "s_name", "status": "'ok'"}, "reason best_recipe kind parent_a result status")


# --- search and candidates


@query("""
WITH p AS (SELECT c_nationkey AS generation, c_custkey AS population_index, c_name AS recipe, c_acctbal > 0 AS valid, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS total FROM customer),
e AS (SELECT c.c_nationkey AS generation, c.c_custkey AS population_index, event_id AS step, event_type AS kind, 'a' || event_id AS parent_a, 'b' || event_id AS parent_b FROM events JOIN customer AS c ON c.c_custkey = user_id),
b AS (SELECT generation, population_index, max_by(kind, step) AS kind, min_by(parent_a, step) AS pa, min_by(parent_b, step) AS pb, count(*) AS n FROM e GROUP BY ALL)
SELECT p.generation, p.population_index, valid, total, coalesce(kind, 'clone') AS operator, coalesce(pa, recipe) AS parent_a, coalesce(pb, 'none') AS parent_b, coalesce(n, 1) AS events FROM p LEFT JOIN b ON p.generation = b.generation AND p.population_index = b.population_index
""")
def search_lineage(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ok = F.col("c_acctbal") > 0
    populations = c.select(F.col("c_nationkey").alias("generation"), F.col("c_custkey").alias("population_index"), F.col("c_name").alias("recipe"), ok.alias("valid"), F.when(ok, F.col("c_acctbal")).otherwise(0.0).alias("total"), F.lit("none").alias("rejection"))
    events = table(spark, sf_dir, "events").join(c, F.col("user_id") == F.col("c_custkey")).select(F.col("c_nationkey").alias("generation"), F.col("c_custkey").alias("population_index"), F.col("event_id").alias("step"), F.col("event_type").alias("kind"), F.concat(F.lit("a"), "event_id").alias("parent_a"), F.concat(F.lit("b"), "event_id").alias("parent_b"))
    out = search.lineage_rows(populations, events)
    return out.select("generation", "population_index", "valid", "total", "operator", "parent_a", F.coalesce("parent_b", F.lit("none")).alias("parent_b"), "events")


@query("SELECT c_nationkey AS generation, c_custkey AS population_index, c_acctbal AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_nationkey, c_custkey LIMIT 1")
def search_winner(spark, sf_dir):
    return search.winner_of(search_lineage(spark, sf_dir)).select("generation", "population_index", "total")


@query("""
WITH p AS (SELECT p_partkey AS k, 'v' || p_partkey AS v FROM part), s AS (SELECT k, v || ' = ' || v || ' + one' AS old, v || ' += one' AS new FROM p)
SELECT CAST(k AS VARCHAR) AS recipe, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'refused' ELSE 'changed' END AS status, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'none' ELSE
  md5('--- a/f' || k || '.c' || chr(10) || '+++ b/f' || k || '.c' || chr(10) || '@@ -1,1 +1,1 @@' || chr(10) || '-' || old || ';' || chr(10) || '+' || new || ';' || chr(10)) END AS patch_md5 FROM s
""")
def candidate_patches(spark, sf_dir):
    """A recipe of one record for each part: its file is rewritten and patched, or the recipe is refused whole."""
    from .model import _facts

    k = F.col("p_partkey")
    v = F.concat(F.lit("v"), k)
    code = F.concat(v, F.lit(" = "), v, F.lit(" + one"))
    base = table(spark, sf_dir, "part").select(k.cast("string").alias("recipe"), F.lit("r").alias("identity"), F.concat(F.lit("f"), k, F.lit(".c")).alias("path"), F.concat(code, F.lit(";\n")).alias("source"), F.length(v).alias("n"), k, F.octet_length(code).alias("end"))
    rows = base.where("p_partkey % 7 <> 0").withColumn("transformation", F.lit(rewrites.ASSIGNMENT)).withColumn("parameter", F.lit("add")).withColumn("location_kind", F.lit("spelling")).withColumn("target_start", F.lit(0)).withColumn("target_end", F.col("end"))
    n = F.col("n")
    requests = _facts(
        rows, form=F.lit("assignment-binary"), operator=F.lit("add"), primary_end=n, duplicate_start=n + 3, duplicate_end=2 * n + 3, operand_start=2 * n + 6, operand_end=F.col("end"),
        primary_declaration=F.lit("d"), duplicate_declaration=F.lit("d"), plain_identifier=F.lit(True), type_matches=F.lit(True), volatile=k % 11 == 0,
    )
    files = base.select("path", F.encode("source", "utf-8").alias("content"))
    out = stages.materialize(base.select("recipe", "identity"), requests, files).results
    return out.select("recipe", "status", F.coalesce(F.md5("patch"), F.lit("none")).alias("patch_md5"))


_CANDIDATE = f"""
WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, 'f' || s_suppkey || '.c' AS path, 'v' || s_suppkey AS v FROM supplier),
first AS (SELECT n, min(k) AS k FROM s GROUP BY n),
c AS (SELECT f.n AS recipe, s.path, s.k = f.k AS edited, s.v || ' = ' || s.v || ' + one' AS old, s.v || ' += one' AS new FROM first AS f, s),
w AS (SELECT *, CASE WHEN edited THEN new ELSE old END || ';' || chr(10) AS content FROM c),
h AS (SELECT *, {fnv_value(ascii_bytes("content"))} AS print FROM w),
r AS (SELECT recipe, count(*) AS n, flatten(list({concat(text("path"), number("strlen(content)"), number("420"), unsigned("print"))} ORDER BY path)) AS b FROM h GROUP BY recipe),
e AS (SELECT recipe, path, old, new, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,1 +1,1 @@' || chr(10) || '-' || old || ';' || chr(10) || '+' || new || ';' || chr(10) AS patch FROM w WHERE edited)
SELECT CAST(recipe AS VARCHAR) AS recipe, {fnv(concat(text(f"'{identity.TAGS['candidate']}'"), text("'base'"), text("'r' || recipe"), number("n"), "b", ascii_bytes("patch")))} AS candidate_fingerprint, path AS changed_path FROM r JOIN e USING (recipe)
"""


@query(_CANDIDATE)
def candidate_fingerprints(spark, sf_dir):
    """A recipe for each nation rewrites its first supplier's file; its candidate's fingerprint holds all suppliers' files."""
    from .model import _facts

    k = F.col("s_suppkey")
    v = F.concat(F.lit("v"), k)
    code = F.concat(v, F.lit(" = "), v, F.lit(" + one"))
    every = table(spark, sf_dir, "supplier").select("s_nationkey", k, F.concat(F.lit("f"), k, F.lit(".c")).alias("path"), F.concat(code, F.lit(";\n")).alias("source"), F.length(v).alias("n"), F.octet_length(code).alias("end"))
    first = every.groupBy("s_nationkey").agg(F.min_by(F.struct("path", "source", "n", "end"), "s_suppkey").alias("f"))
    rows = first.select(F.col("s_nationkey").cast("string").alias("recipe"), F.lit("r").alias("identity"), "f.*").withColumn("transformation", F.lit(rewrites.ASSIGNMENT)).withColumn("parameter", F.lit("add"))
    rows = rows.withColumn("location_kind", F.lit("spelling")).withColumn("target_start", F.lit(0)).withColumn("target_end", F.col("end"))
    n = F.col("n")
    requests = _facts(
        rows, form=F.lit("assignment-binary"), operator=F.lit("add"), primary_end=n, duplicate_start=n + 3, duplicate_end=2 * n + 3, operand_start=2 * n + 6, operand_end=F.col("end"),
        primary_declaration=F.lit("d"), duplicate_declaration=F.lit("d"), plain_identifier=F.lit(True), type_matches=F.lit(True), volatile=F.lit(False),
    )
    heads = rows.select("recipe", F.lit("base").alias("baseline_fingerprint"), F.concat(F.lit("r"), "recipe").alias("recipe_fingerprint"))
    stage = stages.materialize(rows.select("recipe", "identity"), requests, every.select("path", F.encode("source", "utf-8").alias("content")), heads)
    told = F.from_json("json", "recipe_fingerprint string, candidate_fingerprint string, changed_files array<struct<path: string>>")
    return stage.evidence.select("recipe", told.alias("t")).select("recipe", "t.candidate_fingerprint", F.col("t.changed_files")[0]["path"].alias("changed_path"))
