"""Reference checks between tables, and matching with the reason for each failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def foreign_key_violations(child: DataFrame, key: str, columns: list[str], parent: DataFrame, parent_keys: list[str], name: str) -> DataFrame:
    """(relation, key): rows of child whose columns have no row in parent."""
    on = reduce(lambda a, b: a & b, [F.col(f"c.{x}") == F.col(f"p.{y}") for x, y in zip(columns, parent_keys)])
    return child.alias("c").join(parent.select(*parent_keys).distinct().alias("p"), on, "left_anti").select(F.lit(name).alias("relation"), F.col(key).cast("long").alias("key"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Identities that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def match_status(df: DataFrame, checks: list[tuple[Column, str]], fine: str = "ok") -> Column:
    """The name of the first failing check, in order."""
    out = F.lit(fine)
    for failed, name in reversed(checks):
        out = F.when(failed, name).otherwise(out)
    return out


def pairs_by_mask(left: DataFrame, kind: str, right: DataFrame, mask: str, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose left kind (one bit) is in the right mask, without those in `existing`.

    Masks are taken apart into their bits, so that the pairs meet in a join on equality.
    """
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: F.col(mask).cast("long").bitwiseAND(b) != 0)
    allowed = right.withColumn("_bit", F.explode(bits))
    out = left.join(allowed, left[kind].cast("long") == allowed["_bit"]).drop("_bit")
    return out.join(existing.select(*keys), keys, "left_anti")


def dependency_status(records: DataFrame, needs: DataFrame, owner: str, want: str, have: str, forbids: DataFrame) -> DataFrame:
    """For each record and each of its needs: 'resolved', 'missing' (no match) or 'ambiguous' (several), and
    'conflict' where the owner forbids something that is there.

    records(have, ...), needs(owner, want), forbids(owner, want).
    """
    supply = records.groupBy(F.col(have).alias(want)).agg(F.count(F.lit(1)).alias("_n"))
    found = needs.join(supply, want, "left").withColumn("matches", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
    status = F.when(F.col("matches") == 0, "missing").when(F.col("matches") > 1, "ambiguous").otherwise("resolved")
    resolved = found.select(owner, want, "matches", status.alias("status"))
    clashes = forbids.join(supply, want).select(owner, want, F.col("_n").cast("long").alias("matches"), F.lit("conflict").alias("status"))
    return resolved.union(clashes)


def set_difference(a: DataFrame, b: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """(key, state) of the rows that are not the same on both sides: 'added', 'removed' or 'changed'."""
    x, y = a.select(key, F.struct(*payload).alias("x")), b.select(key, F.struct(*payload).alias("y"))
    both = x.join(y, key, "full_outer")
    state = F.when(F.col("y").isNull(), "removed").when(F.col("x").isNull(), "added").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def bind_first(events: DataFrame, slot: list[str], order: str, kind: str, payload: list[str]) -> DataFrame:
    """For each slot: the first event's ordinal and payload, the last event's kind, and how many there were."""
    firsts = [F.min_by(c, order).alias(c) for c in payload]
    return events.groupBy(*slot).agg(F.min(order).alias("birth_ordinal"), F.max_by(kind, order).alias("last_kind"), F.count(F.lit(1)).alias("events"), *firsts)


def winner_row(rows: DataFrame, order: list[str], total: str) -> DataFrame:
    """The first row, in order, that has the largest total."""
    best = rows.agg(F.max(total).alias("_best"))
    hit = rows.join(F.broadcast(best), rows[total] == best["_best"]).drop("_best")  # one row
    return hit.orderBy(*order).limit(1)


def overlapping_edits(edits: DataFrame, path: str, start: str, end: str, identity: str) -> DataFrame:
    """Edits of a file in order, with how they clash with the furthest end before them."""
    w = Window.partitionBy(path).orderBy(start, identity)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return edits.withColumn("position", F.row_number().over(w).cast("long") - 1).withColumn("overlaps", F.coalesce(before > F.col(start), F.lit(False)))
