"""Fingerprints that identify a project's stages: what is hashed, in which order.

Tags keep the fingerprints of different stages apart.  They are parameters, so
that fingerprints of another tool can be met by giving its tags.  `key` names
the documents: one fingerprint for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import canonical as c
from lodestone.functions.fingerprint import fnv1a_text

# What TAGS, the field lists and their order below must be for fingerprints to be the published ones.
TAGS = {
    "baseline": "project-baseline.v1", "analysis": "project-analysis.v1", "build": "project-build-description.v1", "selector": "project-search-selector-v1",
    "candidate": "project-candidate.v1", "condition": "project-measurement-condition-v1", "policy": "project-measurement-policy-v1", "measurement": "project-measurement-result-v1", "assurance": "project-assurance-result-v1",
}
CONDITION = ("baseline_identity", "candidate_fingerprint", "hardware", "operating_system", "compiler", "linker", "flags", "environment", "dataset", "baseline_binary", "candidate_binary")
WEIGHTS = ("correctness", "performance", "memory_use", "reliability", "maintainability", "constraint_penalty")

_FIELD = {"text": c.text, "number": c.number, "flag": c.flag, "real": c.real, "texts": c.texts}


def record(*fields: str) -> Column:
    """Canonical bytes of columns, each given as 'name' (text), 'name:number', 'name:flag', 'name:real' or 'name:texts'."""
    pairs = (f.partition(":") for f in fields)
    return F.concat(*[_FIELD[kind or "text"](F.col(name)) for name, _, kind in pairs])


def _tag(stage: str) -> Column:
    return c.text(F.lit(TAGS[stage]))


def file_set(heads: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """heads(key, manifest_fingerprint long, provider, build_fingerprint long) and files(key, path, size, mode,
    content_fingerprint long) in path order."""
    body = c.rows(files, key, ["path"], record("path", "size:number", "mode:number", "content_fingerprint:number"))
    head = F.concat(_tag("baseline"), record("manifest_fingerprint:number", "provider")).alias("head")
    return c.fingerprints(heads.select(key, head, c.number(F.col("build_fingerprint")).alias("_tail")), key, [body], "_tail")


#: Tables of an analysis in the order they are hashed: the fields of a record, and what orders the records.
ANALYSIS = {
    "translation_units": (("file",), "file"),
    "source_locations": (("identity", "file", "line:number", "column:number", "end_line:number", "end_column:number", "kind:number", "spelling"), "identity"),
    "declarations": (("identity", "name", "unit", "location", "kind:number", "linkage:number", "definition:flag"), "identity"),
    "calls": (("identity", "caller", "callee", "location", "kind:number"), "identity"),
    "control_flows": (("identity", "function", "from_block", "to_block", "location", "kind:number"), "identity"),
    "data_flows": (("identity", "function", "declaration", "location", "kind:number"), "identity"),
    "optimizations": (("identity", "pass", "function", "location", "message", "disposition:number"), "identity"),
    "runtime_records": (("identity", "workload", "function", "location", "metric:number", "value:number"), "identity"),
    "opportunities": (("rank:number", "location", "missed_optimization_count:number", "runtime_evidence_present:flag", "runtime_sample_count:number"), "rank"),
}


def analysis(heads: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """heads(key, baseline_fingerprint, provider, compiler, backend, target, flags, runtime_state long, runtime_profile) and
    the tables of ANALYSIS, each with the key; a table that is not given counts no rows."""
    head = F.concat(_tag("analysis"), record("baseline_fingerprint", "provider", "compiler", "backend", "target", "flags", "runtime_state:number", "runtime_profile")).alias("head")
    sections = [c.rows(tables[t], key, [order], record(*fields)) if t in tables else None for t, (fields, order) in ANALYSIS.items()]
    return c.fingerprints(heads.select(key, head), key, sections)


def candidate(heads: DataFrame, files: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """heads(key, baseline_fingerprint, recipe_fingerprint), files(key, path, size, mode, content_fingerprint long): every
    file of the candidate, edited or not, in path order; patches(key, path, patch): the changed files', as bare bytes."""
    body = c.rows(files, key, ["path"], record("path", "size:number", "mode:number", "content_fingerprint:number"))
    patched = c.rows(patches, key, ["path"], F.encode("patch", "utf-8"))
    head = F.concat(_tag("candidate"), record("baseline_fingerprint", "recipe_fingerprint")).alias("head")
    return c.fingerprints(heads.select(key, head), key, [body, patched], uncounted=(1,))


def build_description(units: DataFrame, key: str) -> DataFrame:
    """units(key, position, file, directory, output, form 'arguments' or 'command', arguments, command), in canonical position."""
    form = F.when(F.col("form") == "arguments", 1).otherwise(2)
    command = F.when(F.col("form") == "arguments", c.texts(F.coalesce("arguments", F.array().cast("array<string>")))).otherwise(c.text(F.col("command")))
    body = c.rows(units, key, ["position"], F.concat(record("file", "directory", "output"), c.number(form), command))
    heads = units.select(key).distinct().withColumn("head", _tag("build"))
    return c.fingerprints(heads, key, [body])


def condition(rows: DataFrame, key: str) -> DataFrame:
    """rows(key and the columns of CONDITION)."""
    return rows.select(key, fnv1a_text(F.concat(_tag("condition"), record(*CONDITION))).alias("fingerprint"))


POLICY = (
    "workload", "warmups:number", "repetitions:number", "minimum_included:number", "order:number", "outliers:number", "deviation_ns:number", "max_range_ppm:number", "tolerance_ppm:number",
    "minimum_improvement_ppm:number", "timeout_ms:number", "weight:real", "memory_weight:real", "binary_weight:real",
)


def policy(heads: DataFrame, workloads: DataFrame, key: str) -> DataFrame:
    """heads(key, policy_id, provider and WEIGHTS) and workloads(key, position and POLICY), in declared position."""
    head = F.concat(_tag("policy"), record("policy_id", "provider")).alias("head")
    tail = record(*[f"{w}:real" for w in WEIGHTS]).alias("_tail")
    return c.fingerprints(heads.select(key, head, tail), key, [c.rows(workloads, key, ["position"], record(*POLICY))], "_tail")


SAMPLE = (
    "workload", "subject:number", "phase:number", "pair_index:number", "sequence_index:number", "completed:flag", "timed_out:flag", "failed:flag", "excluded:flag", "exclusion",
    "condition_fingerprint:number", "runtime_ns:number", "peak_memory:number", "binary_size:number", "reliability:number", "maintainability:number",
)


def measurement(heads: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """heads(key, candidate_fingerprint, assurance_fingerprint, baseline_identity, policy_fingerprint long,
    condition_fingerprint long, comparison long, WEIGHTS as components, total, fitness_available) and samples(key and
    SAMPLE) in sequence."""
    head = F.concat(_tag("measurement"), record("candidate_fingerprint", "assurance_fingerprint", "baseline_identity", "policy_fingerprint:number", "condition_fingerprint:number")).alias("head")
    tail = record("comparison:number", *[f"{w}:real" for w in (*WEIGHTS, "total")], "fitness_available:flag").alias("_tail")
    return c.fingerprints(heads.select(key, head, tail), key, [c.rows(samples, key, ["sequence_index"], record(*SAMPLE))], "_tail")


GATE = (
    "gate", "profile", "stage:number", "required:flag", "disposition:number", "exit_code_and_one:number", "signal:number", "stdout_bytes:number", "stdout_fingerprint", "stderr_bytes:number",
    "stderr_fingerprint", "toolchain_fingerprint", "excerpt", "filesystem_enforced:flag", "network_enforced:flag", "group_clean:flag", "source_modified:flag", "snapshot_modified:flag",
)


def assurance(heads: DataFrame, gates: DataFrame, key: str) -> DataFrame:
    """heads(key, candidate_fingerprint, policy_fingerprint long, provider, stage long, performance_eligible,
    champion_eligible) and gates(key, position, exit_code and the other columns of GATE), in declared position."""
    head = F.concat(_tag("assurance"), record("candidate_fingerprint", "policy_fingerprint:number", "provider", "stage:number")).alias("head")
    tail = record("performance_eligible:flag", "champion_eligible:flag").alias("_tail")
    rows = gates.withColumn("exit_code_and_one", F.col("exit_code") + 1)
    return c.fingerprints(heads.select(key, head, tail), key, [c.rows(rows, key, ["position"], record(*GATE))], "_tail")


#: Budgets of a manifest in the order they are hashed, after its other parts.
BUDGETS = (
    "max_files", "max_file_bytes", "max_total_bytes", "max_path_bytes", "max_compilation_database_bytes", "max_command_output_bytes", "max_evidence_bytes", "command_timeout_ms",
    "max_memory_bytes", "max_processes", "max_storage_bytes", "network_access",
)


def manifest(m: Column) -> Column:
    """Fingerprint text of a parsed manifest (see sources.project): names and values, arrays with their counts."""
    named = lambda name, value: F.concat(c.text(F.lit(name)), value)
    pairs = lambda x, second: F.concat(c.number(F.size(x)), c.joined(F.transform(x, lambda e: F.concat(c.text(e["name"]), c.text(e[second])))))
    parts = [named(n, c.text(m[n])) for n in ("schema", "manifest_id")]
    source, build, search = m["source"], m["build"], m["search"]
    parts += [named("source_identity", c.text(source["declared_identity"])), named("permitted_roots", c.texts(source["permitted_roots"]))]
    parts += [named(n, c.text(source[n])) for n in ("compilation_database", "generated_source_policy")] + [named("build_frontend", c.text(build["frontend"]))]
    for stage in ("configure", "compile", "correctness", "benchmark"):
        parts += [c.text(F.lit(stage)), named("argv", c.texts(build[stage]))]
    parts += [c.flag(build["benchmark_required"]), named("language", c.text(m["target"]["language"])), named("targets", c.texts(m["target"]["platforms"]))]
    parts += [named(n, pairs(m[n], "identity")) for n in ("dependencies", "toolchains")] + [named("environment", pairs(m["environment"], "value"))]
    parts += [named(n, c.texts(m[n])) for n in ("workloads", "constraints")]
    parts += [c.text(F.lit("search")), *[c.number(search[n]) for n in ("seed", "population", "generations", "workers")], c.text(F.lit("budgets"))]
    parts += [c.number(F.coalesce(F.try_element_at(m["budgets"], F.lit(b)), F.lit(0).cast("long"))) for b in BUDGETS]
    parts += [named(n, c.text(F.try_element_at(m["artifacts"], F.lit(n)))) for n in ("retention", "cleanup")]
    return fnv1a_text(F.concat(*parts))


def selector(domain: Column, seed: Column, ordinal: Column, policy_identity: Column, *genomes: Column) -> Column:
    """Fingerprint text that chooses a search's random operations: the genomes' bytes follow as they are."""
    return fnv1a_text(F.concat(_tag("selector"), c.text(domain), c.number(seed), c.number(ordinal), c.text(policy_identity), *genomes))
