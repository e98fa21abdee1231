"""Readers of project manifests, compilation databases, source trees and recorded syntax trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.fingerprint import fnv1a_text
from lodestone.functions.text import join_path, normalize_path, only_keys, relative_path_valid, strict_json_problem

from . import tree, trees

# The closed keys of a compilation record.
COMMAND_KEYS = ["directory", "file", "output", "arguments", "command"]
_COMMAND = "struct<directory: string, file: string, output: string, arguments: array<string>, command: string>"

# The closed keys of a manifest and of its parts.
MANIFEST_KEYS = {
    "": ["schema", "manifest_id", "source", "build", "target", "dependencies", "toolchains", "environment", "workloads", "constraints", "search", "budgets", "artifacts"],
    "source": ["declared_identity", "permitted_roots", "compilation_database", "generated_source_policy"],
    "build": ["frontend", "configure", "compile", "correctness", "benchmark", "benchmark_required"],
    "target": ["language", "platforms"],
    "search": ["seed", "population", "generations", "workers"],
}
# The types of a manifest's parts.
_MANIFEST = """schema string, manifest_id string,
source struct<declared_identity: string, permitted_roots: array<string>, compilation_database: string, generated_source_policy: string>,
build struct<frontend: string, configure: array<string>, compile: array<string>, correctness: array<string>, benchmark: array<string>, benchmark_required: boolean>,
target struct<language: string, platforms: array<string>>, dependencies array<struct<name: string, identity: string>>, toolchains array<struct<name: string, identity: string>>,
environment array<struct<name: string, value: string>>, workloads array<string>, constraints array<string>,
search struct<seed: long, population: long, generations: long, workers: long>, budgets map<string, long>, artifacts map<string, string>"""


def _sorted_distinct(x: Column) -> Column:
    return x == F.array_sort(F.array_distinct(x))


def parse_manifests(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Adds manifest and problem (null where the manifest is accepted): the first rule that a text breaks.

    Rules: strict JSON, the stated schema, closed keys at every level, sorted
    arrays without repeats, valid relative roots, budgets above 0.
    """
    raw = F.col(text)
    m = F.from_json(raw, _MANIFEST)
    rows = df.withColumn("_syntax", strict_json_problem(raw)).withColumn("manifest", m)
    closed = only_keys(raw, MANIFEST_KEYS[""])
    for part in ("source", "build", "target", "search"):
        closed = closed & only_keys(F.get_json_object(raw, f"$.{part}"), MANIFEST_KEYS[part])
    g = lambda p: F.col(f"manifest.{p}")
    ordered = _sorted_distinct(g("source.permitted_roots")) & _sorted_distinct(g("workloads")) & _sorted_distinct(g("constraints"))
    for part in ("dependencies", "toolchains", "environment"):
        ordered = ordered & _sorted_distinct(F.transform(g(part), lambda x: x["name"]))
    roots = F.forall(g("source.permitted_roots"), lambda p: relative_path_valid(p))
    budgets = F.forall(F.map_values(g("budgets")), lambda v: v > 0)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problem = (
        F.col("_syntax").isNotNull(), g("schema").isNull() | (g("schema") != schema), no(closed), no(ordered), no(roots), no(budgets)
    )
    out = F.lit(None).cast("string")
    for failed, name in reversed(list(zip(problem, ("syntax", "schema", "unknown-key", "array-order", "path", "budget")))):
        out = F.when(failed, name).otherwise(out)
    return rows.withColumn("problem", F.when(F.col("_syntax").isNotNull(), F.col("_syntax")).otherwise(out)).drop("_syntax")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_manifests(spark.read.option("wholetext", True).text(path), "value", schema)


def compilation_units(df: DataFrame, text: str, files: DataFrame | None = None, root: str = "/") -> DataFrame:
    """One row per record of compilation databases: directory, file, output, form, arguments, command, problem, in canonical order.

    Exactly one of `arguments` and `command` must be there; other keys are
    refused; paths are resolved against the directory and must stay in the root;
    with files(path), a unit's file must be captured.
    """
    records = df.select(F.explode(F.from_json(text, "array<string>", {"primitivesAsString": "true"})).alias("raw"))
    rows = records.select("raw", F.from_json("raw", _COMMAND).alias("r")).select("raw", "r.*")
    base = root.rstrip("/")
    directory = F.when(F.col("directory").startswith("/"), F.col("directory")).otherwise(F.concat(F.lit(base + "/"), F.col("directory")))
    rows = rows.withColumn("file_path", normalize_path(join_path(directory, F.col("file")), F.lit(base + "/")))
    captured = F.lit(True)
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("_path")).distinct(), F.col("file_path") == F.col("_path"), "left")
        captured = F.col("_path").isNotNull()
    both, none = F.col("arguments").isNotNull() & F.col("command").isNotNull(), F.col("arguments").isNull() & F.col("command").isNull()
    problem = F.when(~only_keys(F.col("raw"), COMMAND_KEYS), "unknown-key").when(both | none, "form").when(F.col("file_path").isNull(), "path").when(~captured, "file-not-captured")
    out = rows.select("directory", F.col("file_path").alias("file"), "output", F.when(F.col("arguments").isNotNull(), "arguments").otherwise("command").alias("form"), "arguments", "command", problem.alias("problem"))
    return out.orderBy("file", "directory", F.col("output").asc_nulls_first(), "form", "command", F.size("arguments"), "arguments")


def source_tree(spark: SparkSession, root: str, max_file_bytes: int, roots: list[str] | None = None, **budgets: int) -> DataFrame:
    """path (relative to root), size, content_fingerprint and content of every file below the permitted roots, in path order.

    Budgets (see sources.tree) are met before any file is opened.
    """
    rows = tree.read_tree(spark, root, roots, max_file_bytes=max_file_bytes, **budgets)
    return rows.select("path", "size", "content", fnv1a_text("content").alias("content_fingerprint")).orderBy("path")


def function_declarations(df: DataFrame, unit: str, tree: str) -> DataFrame:
    """A row for every function declaration of recorded syntax trees (JSON), at any depth: see trees.function_declarations."""
    return trees.function_declarations(trees.nodes(df, unit, tree), unit)


# Flags that a unit's analysis keeps, those it can do without, and prefixes that it refuses.
KEPT_FLAG = r"\A(-std=[A-Za-z0-9+-]+|-[DU][^\x00-\x1F\x7F@]+)\z"
IGNORED_FLAG = r"\A(-c|-g|-pipe|-pthread|-O.*|-W.*)\z"
REFUSED_PREFIXES = (
    "@", "-Xclang", "-load", "-fplugin", "-plugin", "-cc1", "--config", "-include", "-imacros", "-B", "--sysroot", "-isysroot", "-isystem", "-iquote", "-MJ", "-MF", "-MT", "-MQ",
)


def build_arguments(arguments: Column) -> tuple[Column, Column]:
    """(kept flags, supported) of a unit's command line.

    Standards, definitions and include folders stay (a folder after `-I` with
    it); `-o` goes with its operand, and so do ignorable flags and operands.  A
    refused or unknown flag, an include folder that is not a safe relative path,
    or a pair without its second half makes the whole unit unsupported (and its
    flags null).
    """
    safe = lambda p: relative_path_valid(p)

    def step(acc, a):
        bad = lambda: F.struct(acc["kept"].alias("kept"), F.lit("bad").alias("state"))
        put = lambda *more, state="": F.struct(F.concat(acc["kept"], F.array(*more)).alias("kept"), F.lit(state).alias("state"))
        skip = lambda state="": F.struct(acc["kept"].alias("kept"), F.lit(state).alias("state"))
        refused = F.lit(False)
        for prefix in REFUSED_PREFIXES:
            refused = refused | a.startswith(prefix)
        return (
            F.when(acc["state"] == "bad", acc)
            .when(acc["state"] == "output", skip())
            .when(acc["state"] == "include", F.when(safe(a), put(F.lit("-I"), a)).otherwise(bad()))
            .when(F.coalesce(a == "", F.lit(True)) | refused, bad())
            .when(a == "-o", skip("output"))
            .when(a == "-I", skip("include"))
            .when(a.startswith("-I"), F.when(safe(F.substr(a, F.lit(3))), put(a)).otherwise(bad()))
            .when(a.rlike(KEPT_FLAG), put(a))
            .when(a.rlike(IGNORED_FLAG) | ~a.startswith("-"), skip())
            .otherwise(bad())
        )

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit("").alias("state"))
    done = F.aggregate(F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0))), start, step)
    supported = F.coalesce((F.size(arguments) > 0) & (done["state"] == ""), F.lit(False))
    return F.when(supported, done["kept"]), supported
