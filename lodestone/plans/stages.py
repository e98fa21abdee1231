"""The stages from sources to candidates, each composed of the operators: baseline, analysis, candidate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.fingerprint import fnv1a_text
from lodestone.operators import analysis, edits, identity, rewrites
from lodestone.sources import documents, recorded


@dataclass
class Stage:
    """What a stage found: its fingerprint rows, its evidence (key, json, markdown), and what later stages read."""

    fingerprints: DataFrame
    evidence: DataFrame
    results: DataFrame


def _number(text: Column) -> Column:
    """The long of a fingerprint's text form."""
    low, high = F.conv(F.substring(text, -8, 8), 16, 10).cast("long"), F.conv(F.substring(text, -16, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def capture_baseline(projects: DataFrame, files: DataFrame, outcomes: DataFrame, key: str = "subject", output_limit: int = 1 << 20) -> Stage:
    """Baselines of projects(subject, manifest_id, manifest_fingerprint long, build_fingerprint long, provider,
    benchmark_required), their files(subject, path, mode, content) and recorded command outcomes.

    Files are fingerprinted, the recorded stages judged in order, and both put
    into evidence.  results: (subject, state, stages_run).
    """
    rows = files.select(key, "path", "mode", F.octet_length("content").cast("long").alias("size"), fnv1a_text("content").alias("content_fingerprint"))
    prints = identity.file_set(projects, rows.withColumn("content_fingerprint", _number(F.col("content_fingerprint"))), key)
    judged = recorded.command_outcomes(outcomes, output_limit)
    wanted = projects.select(key, "benchmark_required")
    states = recorded.baseline_states(judged.where("problem is null").join(wanted, key), F.col("benchmark_required"))
    heads = projects.join(states, key, "left").join(prints.withColumnRenamed("fingerprint", "baseline_fingerprint"), key)
    heads = heads.withColumn("state", F.coalesce("state", F.lit("build-failed")))
    position = F.lit(len(recorded.STAGES))
    for k, stage in enumerate(recorded.STAGES):
        position = F.when(F.col("stage") == stage, k).otherwise(position)
    commands = judged.withColumn("position", position)
    evidence = documents.documents("baseline", heads, {"files": rows, "commands": commands}, key)
    return Stage(prints, evidence, heads.select(key, "state", F.coalesce("stages_run", F.lit(0)).alias("stages_run")))


def analyze(tables: dict[str, DataFrame], head: DataFrame, files: DataFrame, units: DataFrame, workloads: DataFrame, kinds: dict[str, dict[str, int]], limits: dict[str, int] | None = None) -> Stage:
    """One analysis: recorded tables are checked against the baseline, ordered, fingerprinted and put into evidence.

    head: one row (key, baseline_fingerprint, provider, compiler, backend,
    target, flags, runtime_state, runtime_profile); kinds: for each table the
    codes of its enumerated fields, by name, as 'field.name'.
    """
    model = analysis.build(tables, files, units, workloads)
    model.check(limits)
    only = head.select("key")
    keyed = {}
    for name, df in model.tables.items():
        for field_name, codes in kinds.get(name, {}).items():
            code = F.lit(0)
            for value, number in codes.items():
                code = F.when(F.col(field_name) == value, number).otherwise(code)
            df = df.withColumn(field_name, code)
        keyed[name] = df.join(F.broadcast(only))  # one row
    prints = identity.analysis(head, keyed, "key")
    shown = {name: df.join(F.broadcast(only)) for name, df in model.tables.items()}
    heads = head.join(prints.withColumnRenamed("fingerprint", "analysis_fingerprint"), "key")
    return Stage(prints, documents.documents("analysis", heads, shown, "key"), model.tables["opportunities"])


#: Mode of a file that none is stated for.
REGULAR = 0o644


def materialize(records: DataFrame, requests: DataFrame, files: DataFrame, heads: DataFrame | None = None) -> Stage:
    """Candidates from recipes: every record is applied once, edits are spliced into their files, changed files patched.

    records(recipe, identity); requests(recipe, identity, path, and the columns
    of rewrites.rewrites()); files(path, content[, mode]): the baseline.  A
    recipe with a record that is missing, repeated or refused has status
    'refused', changes nothing and has no fingerprint.  heads(recipe,
    baseline_fingerprint, recipe_fingerprint) say what the candidates' own
    fingerprints start from, which then hold every file and the patches.
    results: (recipe, path, status, patch, before and after sizes and
    fingerprints) of the touched files.
    """
    # The rules are much work on few bytes: by number, so that a small file is not one task and partitions are not put together.
    applied = rewrites.rewrites(requests.repartition(4 * requests.sparkSession.sparkContext.defaultParallelism, "recipe"))
    name = F.concat_ws("\0", "recipe", "identity")
    told = edits.application_status(records.withColumn("_name", name), applied.withColumn("_name", name), "_name").withColumn("recipe", F.split("_name", "\0").getItem(0))
    refused = applied.where("status not in ('edit', 'already-satisfied')").select("recipe").union(told.where("status <> 'matched'").select("recipe")).distinct()
    fine = applied.where("status = 'edit'").join(refused, "recipe", "left_anti")
    place = F.concat_ws("\0", "recipe", "path")
    todo = fine.select(
        place.alias("path"), F.col("target_start").alias("start"), F.col("target_end").alias("end"),
        F.expr("encode(source, 'utf-8')").substr((F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")).alias("before"),
        F.encode("replacement", "utf-8").alias("after"), "identity",
    )
    touched = fine.select("recipe", "path").distinct().join(files, "path").select("recipe", place.alias("path"), "content")
    new = edits.apply_edits(touched, todo)
    old = touched.select(F.col("path").alias("_path"), F.col("content").alias("_old"))
    rows = new.join(old, new.path == old._path)
    parts = F.split("path", "\0")
    patch = edits.whole_file_patch(parts.getItem(1), F.col("_old").cast("string"), F.col("content").cast("string"))
    out = rows.select(parts.getItem(0).alias("recipe"), parts.getItem(1).alias("path"), "status", F.when(F.col("status") == "changed", patch).alias("patch"), "edit_count", "before_size", "before_fingerprint", "after_size", "after_fingerprint")
    none = F.lit(None)
    gone = refused.select("recipe", none.cast("string").alias("path"), F.lit("refused").alias("status"), none.cast("string").alias("patch"), F.lit(0).cast("long").alias("edit_count"), *[none.cast(t).alias(c) for c, t in (("before_size", "long"), ("before_fingerprint", "string"), ("after_size", "long"), ("after_fingerprint", "string"))])
    out = out.unionByName(gone)
    named = records.select("recipe").distinct()
    if heads is None:
        heads = named.select("recipe", F.lit("").alias("baseline_fingerprint"), fnv1a_text("recipe").alias("recipe_fingerprint"))
    mode = F.col("mode") if "mode" in files.columns else F.lit(REGULAR)
    held = files.select("path", mode.cast("long").alias("mode"), F.octet_length("content").cast("long").alias("size"), fnv1a_text("content").alias("content_fingerprint"))
    # A candidate holds every file of the baseline: sizes and fingerprints alone, those of its changed files instead of the old ones.
    kept = named.join(refused, "recipe", "left_anti")
    changed = out.where("status = 'changed'").select(F.col("recipe").alias("_r"), F.col("path").alias("_p"), "after_size", "after_fingerprint")
    whole = kept.crossJoin(held).join(changed, (F.col("recipe") == F.col("_r")) & (F.col("path") == F.col("_p")), "left")
    whole = whole.select("recipe", "path", F.coalesce("after_size", "size").alias("size"), "mode", _number(F.coalesce("after_fingerprint", "content_fingerprint")).alias("content_fingerprint"))
    prints = identity.candidate(heads.join(kept, "recipe", "left_semi"), whole, out.where("status = 'changed'").select("recipe", "path", "patch"), "recipe")
    shown = heads.join(prints.withColumnRenamed("fingerprint", "candidate_fingerprint"), "recipe")
    evidence = documents.documents("candidate", shown, {"changed_files": out.where("status = 'changed'")}, "recipe")
    return Stage(prints, evidence, out)
