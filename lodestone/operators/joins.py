"""Joins on a few keys: a small side goes to every task, so that a large one is not dealt out into as many partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a small table that may go to every task.
FEW = 10_000


def _sent(df: DataFrame) -> DataFrame | None:
    rows = df.limit(FEW + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= FEW else None


def few(df: DataFrame) -> DataFrame:
    """The same rows, computed once and sent to every task if they are at most FEW; else as they are."""
    sent = _sent(df)
    return df if sent is None else sent


def wanted(known: DataFrame, column: str, rows: DataFrame, of: str) -> DataFrame:
    """Rows of known whose column occurs in rows[of], sent to every task if known rows or the values of rows[of] are few;
    else all of known.  A column of few values has many rows of each, whatever the size of known."""
    sent = _sent(known)
    if sent is None:
        values = _sent(rows.select(rows[of].alias("_value")).distinct())
        sent = None if values is None else few(known.join(values, known[column] == F.col("_value"), "left_semi"))
    return known if sent is None else sent
