"""Evidence documents of the stages: canonical JSON and a Markdown view, one row for each document.

A document has a schema name, head fields, and relations in canonical order.
JSON keeps the order of fields as stated, nulls included; Markdown has a list
of the head and a table for each relation.  A document holds the evidence of one
stage of one key, whose size the stage's budgets bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import identity

_KEEP = {"ignoreNullFields": "false"}


@dataclass(frozen=True)
class Relation:
    """Rows of a document: their fields, in this order, sorted by `order` (a column; given fields alone are shown)."""

    name: str
    fields: tuple[str, ...]
    order: str


@dataclass(frozen=True)
class Kind:
    schema: str
    title: str
    head: tuple[str, ...]
    relations: tuple[Relation, ...] = ()


def _plain(fields) -> tuple[str, ...]:
    return tuple(f.partition(":")[0] for f in fields)


KINDS = {
    "baseline": Kind("baseline.v1", "Baseline", ("manifest_id", "provider", "state", "baseline_fingerprint"), (
        Relation("files", ("path", "size", "mode", "content_fingerprint"), "path"),
        Relation("commands", ("stage", "disposition", "exit_code", "output_bytes", "output"), "position"))),
    "analysis": Kind("analysis.v1", "Analysis", ("baseline_fingerprint", "provider", "compiler", "target", "analysis_fingerprint"), tuple(
        Relation(name, _plain(fields), order) for name, (fields, order) in identity.ANALYSIS.items())),
    "catalogue": Kind("transformation-catalogue.v1", "Transformation catalogue", ("identity", "version"), (
        Relation("entries", ("transformation", "version", "mask", "dependencies", "conflicts"), "transformation"),)),
    "recipe": Kind("recipe.v1", "Recipe", ("recipe_fingerprint", "catalogue", "catalogue_version"), (
        Relation("records", ("identity", "transformation", "version", "target", "file", "opportunity_rank", "dependency_records", "compiler_records", "runtime_records"), "position"),)),
    "application": Kind("transformation-application.v1", "Applied transformation", ("recipe_fingerprint", "record", "transformation", "status"), (
        Relation("edits", ("path", "before_start", "before_end", "before_fingerprint", "after_start", "after_end", "replacement_fingerprint"), "before_start"),)),
    "candidate": Kind("candidate.v1", "Candidate", ("recipe_fingerprint", "baseline_fingerprint", "candidate_fingerprint"), (
        Relation("changed_files", ("path", "before_size", "before_fingerprint", "after_size", "after_fingerprint", "edit_count"), "path"),)),
    "assurance": Kind("assurance.v1", "Assurance", ("candidate_fingerprint", "stage", "performance_eligible", "champion_eligible"), (
        Relation("gates", ("gate", "profile", "stage", "required", "disposition", "exit_code"), "position"),)),
    "measurement": Kind("measurement.v1", "Measurement", ("candidate_fingerprint", "comparison", "fitness_available", "total"), (
        Relation("workloads", ("workload", "complete", "stable", "comparison", "runtime_improvement", "memory_improvement"), "workload"),
        Relation("samples", ("workload", "subject", "phase", "pair_index", "sequence_index", "runtime_ns", "exclusion"), "sequence_index"))),
    "search": Kind("search.v1", "Search", ("seed", "generations", "reason", "best_recipe", "best_total"), (
        Relation("events", ("generation", "population_index", "step", "kind", "parent_a", "parent_b", "result", "status"), "ordinal"),
        Relation("lineage", ("generation", "population_index", "recipe", "valid", "total", "rejection", "operator", "parent_a", "parent_b", "events"), "ordinal"))),
}


def _cell(x: Column) -> Column:
    return F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))


def documents(kind: str, heads: DataFrame, relations: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, json, markdown) for each row of heads(key and the kind's head fields); relations hold rows by key.

    A relation that is not given, or has no rows for a key, is an empty array.
    """
    told = KINDS[kind]
    out = heads
    for k, r in enumerate(told.relations):
        if r.name not in relations:
            out = out.withColumn(f"_json{k}", F.lit("")).withColumn(f"_lines{k}", F.lit(""))
            continue
        fields = [f for f in r.fields if f in relations[r.name].columns]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(F.col(f)) for f in fields]), F.lit(" |"))
        item = F.struct(F.col(r.order).alias("_order"), F.to_json(F.struct(*fields), _KEEP).alias("j"), line.alias("l"))
        rows = relations[r.name].groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_rows"))  # one document's evidence
        rows = rows.select(key, F.array_join(F.transform("_rows", lambda x: x["j"]), ",").alias(f"_json{k}"), F.concat(F.lit("\n"), F.array_join(F.transform("_rows", lambda x: x["l"]), "\n")).alias(f"_lines{k}"))
        out = out.join(rows, key, "left")
    quoted = F.to_json(F.struct(F.lit(told.schema).alias("schema"), *told.head), _KEEP)
    parts = [F.substr(quoted, F.lit(1), F.length(quoted) - 1)]
    marks = [F.lit(f"# {told.title}\n\n- schema: `{told.schema}`\n")] + [F.concat(F.lit(f"- {h}: `"), F.coalesce(F.col(h).cast("string"), F.lit("")), F.lit("`\n")) for h in told.head]
    for k, r in enumerate(told.relations):
        shown = [f for f in r.fields if r.name in relations and f in relations[r.name].columns] or list(r.fields)
        parts.append(F.concat(F.lit(f',"{r.name}":['), F.coalesce(f"_json{k}", F.lit("")), F.lit("]")))
        title = f"\n## {r.name.replace('_', ' ').capitalize()}\n\n| " + " | ".join(shown) + " |\n|" + " --- |" * len(shown)
        marks.append(F.concat(F.lit(title), F.coalesce(f"_lines{k}", F.lit("")), F.lit("\n")))
    return out.select(key, F.concat(*parts, F.lit("}")).alias("json"), F.concat(*marks).alias("markdown"))


def publish(evidence: DataFrame, folder: str, patches: DataFrame | None = None) -> None:
    """Writes json, markdown (and patches(value)) under a folder; nothing is ever written over.

    A marker file says `incomplete` until all parts are there.
    """
    spark = evidence.sparkSession
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{folder}/_INCOMPLETE")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(marker.getParent()):
        raise FileExistsError(folder)
    fs.create(marker, False).close()
    for column in ("json", "markdown"):
        evidence.select(F.col(column).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{folder}/{column}")
    if patches is not None:
        patches.select("value").coalesce(1).write.mode("errorifexists").text(f"{folder}/patch")
    fs.delete(marker, False)
