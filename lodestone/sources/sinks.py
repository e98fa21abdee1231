"""Evidence sinks: canonical JSON and Markdown, never over something that is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, `value`: the rows as a JSON array in the given order, keys in column order, nulls kept."""
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"])  # evidence of one run: bounded by its budgets
    return df.agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("value"))


def markdown(df: DataFrame, order: list[str], title: str) -> DataFrame:
    """One row, `value`: a Markdown table of the rows in the given order."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line: Column = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], line.alias("l"))
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n"
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["l"])
    return df.agg(F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit("\n")).alias("value"))


def publish(evidence: DataFrame, folder: str) -> None:
    """Written as text; fails where the folder exists.  Spark's commit protocol leaves _SUCCESS only when all is there."""
    evidence.coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(folder)


def append_trace(df: DataFrame, folder: str, generation: int) -> None:
    """One generation's rows, added to a trace partitioned by generation."""
    df.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(folder)
