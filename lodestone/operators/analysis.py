"""The analysis model: rules of its tables, opportunities from remarks and samples, and whether it is current.

Tables are DataFrames with an `identity` for each record; references name the
identity of a record of another table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import wanted
from .ordered import total_rank

# Kinds of the tables' records.
LOCATION_KINDS = ("spelling", "macro-expansion", "generated")
DECLARATION_KINDS, LINKAGES = ("function", "variable", "type"), ("none", "internal", "external")
CALL_KINDS = ("direct", "indirect")
CONTROL_KINDS = ("fallthrough", "branch-true", "branch-false", "back-edge", "return")
DATA_KINDS = ("read", "write", "read-write")
DISPOSITIONS = ("applied", "missed", "analysis")
METRICS = ("sample-count",)


def opportunities(missed: DataFrame, runtime: DataFrame, location: str, samples: str) -> DataFrame:
    """One row per location of either table, ranked by: evidence there, samples, missed remarks, location.

    missed(location) has a row for each missed remark, runtime(location, samples)
    a row for each sample record.
    """
    none = F.lit(0).cast("long")
    both = missed.select(location, F.lit(1).cast("long").alias("m"), none.alias("s"), F.lit(False).alias("e")).unionByName(
        runtime.select(location, none.alias("m"), F.col(samples).cast("long").alias("s"), F.lit(True).alias("e"))
    )
    out = both.groupBy(location).agg(F.sum("m").alias("missed_optimization_count"), F.bool_or("e").alias("runtime_evidence_present"), F.sum("s").alias("runtime_sample_count"))
    # The rank is a total order over all locations: falling evidence, samples and remarks as rising columns.
    order = [~F.col("runtime_evidence_present"), -F.col("runtime_sample_count"), -F.col("missed_optimization_count"), F.col(location)]
    return total_rank(out, order, "rank").withColumn("rank", F.col("rank") + 1)


def range_valid(line: Column, column: Column, end_line: Column, end_column: Column) -> Column:
    """Places count from 1 and the end is not before the start."""
    return (line >= 1) & (column >= 1) & ((end_line > line) | ((end_line == line) & (end_column >= column)))


def mask_allows(allowed: Column, kind: Column) -> Column:
    return allowed.bitwiseAND(kind) != 0


def mask_covers(have: Column, need: Column) -> Column:
    return have.bitwiseAND(need) == need


def _present(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def record_problems(rows: DataFrame, checks: list[tuple[str, Column]], references: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(identity, problem) of records that break a rule: the first of the checks, then of the references, then 'duplicate'.

    checks: (problem, condition that must hold); references: (problem, column,
    table, its column): the value must be there.
    """
    fine = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        fine = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(fine)
    out = rows.withColumn("_check", fine)
    missing = F.lit(None).cast("string")
    for k, (_, column, parent, key) in enumerate(references):
        known = wanted(_present(parent, key, f"_ref{k}"), f"_ref{k}", rows, column)
        out = out.join(known, out[column] == known[f"_ref{k}"], "left")
    for k, (name, *_) in reversed(list(enumerate(references))):
        missing = F.when(F.col(f"_ref{k}").isNull(), name).otherwise(missing)
    copies = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").select(F.col("identity").alias("_twice"))
    out = out.join(copies, out.identity == copies._twice, "left")
    problem = F.coalesce("_check", missing, F.when(F.col("_twice").isNotNull(), "duplicate"))
    return out.select("identity", problem.alias("problem")).where("problem is not null")


def location_problems(locations: DataFrame, files: DataFrame) -> DataFrame:
    """Locations(identity, file, line, column, end_line, end_column, kind, spelling): a kind that is known and not
    'generated', a valid range, a captured file; an expansion refers to another location that is a spelling, and a
    spelling to none."""
    spellings = locations.where("kind = 'spelling'").select(F.col("identity").alias("_spelling"))
    rows = locations.withColumn("_to", F.when(F.col("kind") == "macro-expansion", F.col("spelling")).otherwise(F.lit("")))
    parents = spellings.union(locations.sparkSession.createDataFrame([("",)], "_spelling string"))
    checks = [
        ("kind", F.col("kind").isin(*LOCATION_KINDS)),
        ("generated-location", F.col("kind") != "generated"),
        ("range", range_valid(F.col("line"), F.col("column"), F.col("end_line"), F.col("end_column"))),
        ("spelling-refers", (F.col("kind") != "spelling") | F.col("spelling").isNull()),
        ("spelling-not-resolved", (F.col("kind") != "macro-expansion") | (F.col("spelling").isNotNull() & (F.col("spelling") != F.col("identity")))),
    ]
    return record_problems(rows, checks, [("file-not-captured", "file", files, "path"), ("spelling-not-resolved", "_to", parents, "_spelling")])


def declaration_problems(declarations: DataFrame, units: DataFrame, locations: DataFrame) -> DataFrame:
    checks = [("kind", F.col("kind").isin(*DECLARATION_KINDS)), ("linkage", F.col("linkage").isin(*LINKAGES)), ("name", F.length("name") > 0)]
    return record_problems(declarations, checks, [("unit", "unit", units, "file"), ("location", "location", locations, "identity")])


def functions_of(declarations: DataFrame) -> DataFrame:
    return declarations.where("kind = 'function'").select("identity")


def call_problems(calls: DataFrame, declarations: DataFrame, locations: DataFrame) -> DataFrame:
    known = functions_of(declarations)
    refs = [("caller", "caller", known, "identity"), ("callee", "callee", known, "identity"), ("location", "location", locations, "identity")]
    return record_problems(calls, [("kind", F.col("kind").isin(*CALL_KINDS))], refs)


def control_problems(flows: DataFrame, declarations: DataFrame, locations: DataFrame) -> DataFrame:
    checks = [("kind", F.col("kind").isin(*CONTROL_KINDS)), ("block", (F.length("from_block") > 0) & (F.length("to_block") > 0))]
    return record_problems(flows, checks, [("function", "function", functions_of(declarations), "identity"), ("location", "location", locations, "identity")])


def data_problems(flows: DataFrame, declarations: DataFrame, locations: DataFrame) -> DataFrame:
    refs = [("function", "function", functions_of(declarations), "identity"), ("declaration", "declaration", declarations, "identity"), ("location", "location", locations, "identity")]
    return record_problems(flows, [("kind", F.col("kind").isin(*DATA_KINDS))], refs)


def optimization_problems(records: DataFrame, declarations: DataFrame, locations: DataFrame) -> DataFrame:
    checks = [("disposition", F.col("disposition").isin(*DISPOSITIONS)), ("text", (F.length("pass") > 0) & (F.length("message") > 0))]
    return record_problems(records, checks, [("function", "function", functions_of(declarations), "identity"), ("location", "location", locations, "identity")])


def runtime_problems(records: DataFrame, workloads: DataFrame, declarations: DataFrame, locations: DataFrame) -> DataFrame:
    checks = [("metric", F.col("metric").isin(*METRICS)), ("value", F.col("value") > 0)]
    refs = [("workload", "workload", workloads, "workload"), ("function", "function", functions_of(declarations), "identity"), ("location", "location", locations, "identity")]
    return record_problems(records, checks, refs)


@dataclass
class Model:
    """Tables in canonical order (by identity; opportunities by rank), and the problems of all of them."""

    tables: dict[str, DataFrame]
    problems: DataFrame
    required: tuple[str, ...] = field(default=("source_locations", "declarations"))

    def check(self, limits: dict[str, int] | None = None) -> None:
        """Raises for a required table without rows, a table over its limit, or any problem."""
        for name, limit in (limits or {}).items():
            if self.tables[name].limit(limit + 1).count() > limit:
                raise ValueError(f"{name} is over its limit")
        for name in self.required:
            if self.tables[name].isEmpty():
                raise ValueError(f"{name} has no rows")
        first = self.problems.orderBy("relation", "identity").first()
        if first is not None:
            raise ValueError(f"{first['relation']} {first['identity']}: {first['problem']}")


def build(tables: dict[str, DataFrame], files: DataFrame, units: DataFrame, workloads: DataFrame, runtime_available: bool = True) -> Model:
    """The model of recorded tables (those of sources.recorded.ANALYSIS_TABLES) over a baseline's files(path),
    units(file) and workloads(workload).  Without an available profile there must be no runtime records."""
    t = tables
    where, what = t["source_locations"], t["declarations"]
    found = {
        "source_locations": location_problems(where, files),
        "declarations": declaration_problems(what, units, where),
        "calls": call_problems(t["calls"], what, where),
        "control_flows": control_problems(t["control_flows"], what, where),
        "data_flows": data_problems(t["data_flows"], what, where),
        "optimizations": optimization_problems(t["optimizations"], what, where),
        "runtime_records": runtime_problems(t["runtime_records"], workloads, what, where)
        if runtime_available
        else t["runtime_records"].select("identity", F.lit("profile-not-available").alias("problem")),
    }
    problems = reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("relation"), "identity", "problem") for name, p in found.items()])
    ordered = {name: df.orderBy("identity") for name, df in tables.items()}
    missed = t["optimizations"].where("disposition = 'missed'").select("location")
    ordered["opportunities"] = opportunities(missed, t["runtime_records"], "location", "value").orderBy("rank")
    ordered["translation_units"] = translation_units(units)
    return Model(ordered, problems)


def translation_units(units: DataFrame, max_units: int | None = None, max_path_bytes: int | None = None) -> DataFrame:
    """The distinct units(file) in order; raises where there are none, or one of the budgets, if given, is passed."""
    out = units.select("file").distinct()
    if max_units is not None or max_path_bytes is not None:
        found = out.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("file")).alias("longest")).first()
        if found["n"] == 0:
            raise ValueError("there are no translation units")
        if max_units is not None and found["n"] > max_units:
            raise ValueError(f"{found['n']} translation units are over the limit")
        if max_path_bytes is not None and found["longest"] > max_path_bytes:
            raise ValueError("the path of a translation unit is over the limit")
    return out.orderBy("file")


def published(heads: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """The public view of analyses: their heads, how many rows each table has for them, and that the view is whole.

    One pass over all tables: rows are counted by (key, table) and turned into columns n_<table>.
    """
    names = sorted(tables)
    rows = reduce(DataFrame.unionByName, [tables[t].select(key, F.lit(t).alias("_table")) for t in names])
    counted = rows.groupBy(F.col(key).alias("_key")).agg(*[F.count_if(F.col("_table") == t).alias(f"n_{t}") for t in names])
    out = heads.join(counted, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return out.withColumns({f"n_{t}": F.coalesce(f"n_{t}", F.lit(0)).cast("long") for t in names}).withColumn("projection_complete", F.lit(True)).withColumn("probabilistic_authority", F.lit(False))


def is_current(stated: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """(key, current): whether the stated fingerprint of each document is the one computed now; a missing one is not."""
    both = stated.select(key, F.col("fingerprint").alias("_stated")).join(computed.select(key, F.col("fingerprint").alias("_now")), key, "full_outer")
    return both.select(key, F.coalesce(F.col("_stated") == F.col("_now"), F.lit(False)).alias("current"))
