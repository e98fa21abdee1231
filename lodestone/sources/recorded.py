"""Recorded results of programs that Spark does not run: analyses, command outcomes, workloads, and file snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.fingerprint import fnv1a_text
from lodestone.functions.text import relative_path_valid
from lodestone.operators import assurance, integrity

# The tables of a recorded analysis and their columns.
ANALYSIS_TABLES = {
    "source_locations": "identity string, file string, line long, column long, end_line long, end_column long, kind string, spelling string",
    "declarations": "identity string, name string, unit string, location string, kind string, linkage string, definition boolean",
    "calls": "identity string, caller string, callee string, location string, kind string",
    "control_flows": "identity string, function string, from_block string, to_block string, location string, kind string",
    "data_flows": "identity string, function string, declaration string, location string, kind string",
    "optimizations": "identity string, pass string, function string, location string, message string, disposition string",
    "runtime_records": "identity string, workload string, function string, location string, metric string, value long",
}
# Stages of a baseline in the order they run.
STAGES = ("configure", "compile", "correctness", "benchmark")
OUTCOME = "subject string, stage string, timed_out boolean, exit_code long, output_bytes long, output_fingerprint long"


def read_analysis(spark: SparkSession, folder: str, format: str = "json") -> dict[str, DataFrame]:
    """The tables of a recorded analysis, one folder each; a table that is not there has no rows.

    An analysis without locations or declarations is refused.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, schema in ANALYSIS_TABLES.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(conf).exists(path)
        reader = spark.read.schema(schema)
        out[name] = (reader.option("mode", "FAILFAST").json(f"{folder}/{name}") if format == "json" else reader.parquet(f"{folder}/{name}")) if there else spark.createDataFrame([], schema)
    for name in ("source_locations", "declarations"):
        if out[name].isEmpty():
            raise ValueError(f"the analysis has no {name}")
    return out


def command_outcomes(rows: DataFrame, output_limit: int, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Recorded outcomes (OUTCOME) of commands or sandboxed processes, judged one by one.

    Adds disposition, problem (null where the record is sound: a known stage,
    an exit code in 0..255 that is 0 after a timeout, output within its limit)
    and output, the fingerprint as text.
    """
    c = F.col
    problem = (
        F.when(~F.coalesce(c("stage").isin(*stages), F.lit(False)), "stage")
        .when(~F.coalesce(c("exit_code").between(0, 255), F.lit(False)) | (c("timed_out") & (c("exit_code") != 0)), "exit-code")
        .when(~F.coalesce(c("output_bytes").between(0, output_limit), F.lit(False)), "output")
    )
    output = F.concat(F.lit("fnv1a64-v1:"), F.lower(F.lpad(F.hex(c("output_fingerprint")), 16, "0")))
    return rows.withColumn("disposition", assurance.command_disposition(c("timed_out"), c("exit_code"))).withColumn("problem", problem).withColumn("output", output)


def read_outcomes(spark: SparkSession, path: str, output_limit: int) -> DataFrame:
    return command_outcomes(spark.read.schema(OUTCOME).option("mode", "FAILFAST").json(path), output_limit)


def baseline_states(outcomes: DataFrame, benchmark_required: Column) -> DataFrame:
    """(subject, state, stages_run): stages run in order and stop at the first that did not pass or is not recorded."""
    passed = lambda s: F.coalesce(F.bool_or((F.col("stage") == s) & (F.col("disposition") == "passed")), F.lit(False))
    rows = outcomes.groupBy("subject").agg(*[passed(s).alias(s) for s in STAGES], F.first(benchmark_required).alias("_required"))
    c = F.col
    state = assurance.baseline_state(c("configure"), c("compile"), c("correctness"), c("benchmark") | ~c("_required"))
    ran = F.lit(1) + F.when(c("configure"), F.lit(1) + F.when(c("compile"), F.lit(1) + F.when(c("correctness"), 1).otherwise(0)).otherwise(0)).otherwise(0)
    return rows.select("subject", state.alias("state"), ran.cast("long").alias("stages_run"))


def workload_of(rows: DataFrame, column: str, registry: DataFrame) -> DataFrame:
    """Adds the registry's columns for the first entry (by position) of each row's workload; nulls where there is none.

    registry(workload, position, ...) is small: Spark decides how to join it.
    """
    names = [c for c in registry.columns if c not in ("workload", "position")]
    first = registry.groupBy(F.col("workload").alias("_workload")).agg(*[F.min_by(c, "position").alias(c) for c in names])
    return rows.join(first, rows[column] == first._workload, "left").drop("_workload")


# --- snapshots of source trees

def file_records(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, size, content_fingerprint."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), fnv1a_text("content").alias("content_fingerprint"))


def file_problems(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, problem) of files(path, content) against recorded(path, size, content_fingerprint): missing, unknown, size or
    content."""
    now = file_records(files).select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("content_fingerprint").alias("_print"))
    both = recorded.join(now, recorded.path == now._path, "full_outer")
    problem = F.when(F.col("_path").isNull(), "missing").when(F.col("path").isNull(), "unknown").when(F.col("size") != F.col("_size"), "size").when(F.col("content_fingerprint") != F.col("_print"), "content")
    return both.select(F.coalesce("path", "_path").alias("path"), problem.alias("problem")).where("problem is not null")


def byte_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, state) of files(path, content) that are not byte for byte the same on both sides."""
    return integrity.set_difference(a, b, "path", ["content"])


def prepare_snapshot(files: DataFrame, folder: str, max_files: int, max_file_bytes: int, max_total_bytes: int) -> DataFrame:
    """Copies files(path, content) to folder/files as Parquet, with their records in folder/records; returns the records.

    Refuses unsafe paths, repeated paths and trees over a budget before it
    writes; what is there already is never written over.
    """
    records = file_records(files)
    sums = records.agg(F.count(F.lit(1)), F.count_distinct("path"), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(~relative_path_valid(F.col("path")))).first()
    for failed, name in ((sums[4], "path"), (sums[0] != sums[1], "repeated path"), (sums[0] > max_files, "files"), (sums[2] > max_file_bytes, "file size"), (sums[3] > max_total_bytes, "total size")):
        if failed:
            raise ValueError(f"snapshot refused: {name}")
    files.select("path", "content").write.mode("errorifexists").parquet(f"{folder}/files")
    records.write.mode("errorifexists").parquet(f"{folder}/records")
    return files.sparkSession.read.parquet(f"{folder}/records")


def commit_snapshot(spark: SparkSession, prepared: str, final: str) -> None:
    """Verifies a prepared snapshot against its records and gives it its final name in one rename."""
    problems = file_problems(spark.read.parquet(f"{prepared}/files"), spark.read.parquet(f"{prepared}/records"))
    first = problems.orderBy("path").first()
    if first is not None:
        raise ValueError(f"snapshot changed: {first['path']} ({first['problem']})")
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(prepared), jvm.org.apache.hadoop.fs.Path(final)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        raise ValueError("a snapshot of that name is there already")


def snapshot_files(spark: SparkSession, folder: str, paths: DataFrame, limit: int) -> DataFrame:
    """(path, content, problem) of the asked files of a committed snapshot: missing, over the limit, or changed since."""
    asked = paths.select("path").distinct()
    files, records = spark.read.parquet(f"{folder}/files"), spark.read.parquet(f"{folder}/records")
    rows = asked.join(records, "path", "left").join(files, "path", "left").withColumn("_now", fnv1a_text("content"))
    changed = (F.octet_length("content") != F.col("size")) | (F.col("_now") != F.col("content_fingerprint"))
    problem = F.when(F.col("size").isNull() | F.col("content").isNull(), "missing").when(F.col("size") > limit, "limit").when(changed, "changed")
    return rows.select("path", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))
