"""Recorded syntax trees as tables: a row for each node, with the interval of its descendants.

Nodes are numbered in the order of a walk (`pre`), and `last` is the number of
a node's last descendant, so `a.pre <= b.pre <= a.last` says that b is a or lies
below it.  Questions about trees are joins and windows over these columns.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TEXTS = ("kind", "opcode", "name", "storage", "type", "left_type", "result_type", "file", "ref_id", "ref_name", "ref_type", "first_kind", "first_opcode", "parent_kind")
_NUMBERS = ("pre", "last", "parent", "depth", "place", "start", "end", "line", "column")
_FLAGS = ("macro", "refers", "has_macro", "has_volatile", "has_extension")
NODE = ", ".join([*(f"`{c}` long" for c in _NUMBERS), *(f"{c} string" for c in _TEXTS), *(f"{c} boolean" for c in _FLAGS)])


def _said(value, *path: str) -> str | None:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value if isinstance(value, str) else None


def _range(node: dict) -> tuple[int | None, int | None, bool]:
    """(start, end, from a macro) of a node's bytes; no start where the tree states none."""
    macro, places = False, []
    for side in ("begin", "end"):
        at = (node.get("range") or {}).get(side) or {}
        if "expansionLoc" in at or "spellingLoc" in at:
            macro, at = True, at.get("expansionLoc") or {}
        if "offset" not in at or "tokLen" not in at:
            return None, None, macro
        places.append((at["offset"], at["tokLen"]))
    start, end = places[0][0], sum(places[1])
    return (start, end, macro) if start < end else (None, None, macro)


def _rows(tree: dict) -> list[dict]:
    """A row for each object of a tree, in the order of a walk that keeps a stack of its own."""
    rows: list[dict] = []
    stack = [(tree, -1, 0, 0)]
    while stack:
        x, parent, depth, place = stack.pop()
        inner = [c for c in x.get("inner") or []]
        own = json.dumps({k: v for k, v in x.items() if k != "inner"})
        start, end, macro = _range(x)
        at, first, ref = x.get("loc") or {}, inner[0] if inner and isinstance(inner[0], dict) else {}, x.get("referencedDecl")
        row = {
            "pre": len(rows), "last": len(rows), "parent": parent, "depth": depth, "place": place, "start": start, "end": end, "line": at.get("line"), "column": at.get("col"),
            "kind": _said(x, "kind"), "opcode": _said(x, "opcode"), "name": _said(x, "name"), "storage": _said(x, "storageClass"), "type": _said(x, "type", "qualType"),
            "left_type": _said(x, "computeLHSType", "qualType"), "result_type": _said(x, "computeResultType", "qualType"), "file": _said(at, "file"),
            "ref_id": _said(ref, "id"), "ref_name": _said(ref, "name"), "ref_type": _said(ref, "type", "qualType"), "first_kind": _said(first, "kind"), "first_opcode": _said(first, "opcode"),
            "parent_kind": rows[parent]["kind"] if parent >= 0 else None, "macro": macro, "refers": isinstance(ref, dict),
            "has_macro": '"expansionLoc"' in own or '"spellingLoc"' in own, "has_volatile": "volatile" in own, "has_extension": "__int128" in own or x.get("kind") == "StmtExpr",
        }
        rows.append(row)
        stack.extend((c, row["pre"], depth + 1, k) for k, c in reversed(list(enumerate(inner))) if isinstance(c, dict))
    for row in reversed(rows):  # children come after their parents
        if row["parent"] >= 0:
            above = rows[row["parent"]]
            above["last"] = max(above["last"], row["last"])
            for flag in ("has_macro", "has_volatile", "has_extension"):
                above[flag] = above[flag] or row[flag]
    return rows


def nodes(df: DataFrame, unit: str, tree: str) -> DataFrame:
    """(unit and NODE): a row for every object of each unit's tree; a tree that cannot be read has one row, of pre -1."""
    kind = dict(df.dtypes)[unit]
    schema = f"{unit} {kind}, {NODE}"
    columns = [*((c, pa.int64()) for c in _NUMBERS), *((c, pa.string()) for c in _TEXTS), *((c, pa.bool_()) for c in _FLAGS)]

    def run(batches):
        for batch in batches:
            for u, t in zip(batch.column(0), batch.column(1).to_pylist()):
                try:
                    found = _rows(json.loads(t))
                except (ValueError, TypeError, AttributeError):
                    found = [{"pre": -1, "last": -1}]
                units = pa.array([u.as_py()] * len(found), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([units, *[pa.array([r.get(c) for r in found], k) for c, k in columns]], names=[unit, *(c for c, _ in columns)])

    return df.select(unit, tree).mapInArrow(run, schema)


def exact_nodes(requests: DataFrame, trees: DataFrame, unit: str) -> DataFrame:
    """requests(unit, target_start, target_end, kind, opcode or null) with status and the one node's pre.

    A node of the kind (and opcode) that covers exactly the target: 'found'
    where there is one, 'ambiguous-target' where there are more, else
    'not-applicable'; 'facts-malformed' where the tree cannot be read.
    """
    keys = [unit, "target_start", "target_end", "kind", "opcode"]
    asked = requests.select(*keys).distinct()
    n = trees.select(F.col(unit).alias("_u"), "pre", "start", "end", F.col("kind").alias("_k"), F.col("opcode").alias("_o"))
    same = (F.col(unit) == F.col("_u")) & (F.col("target_start") == F.col("start")) & (F.col("target_end") == F.col("end")) & (F.col("kind") == F.col("_k")) & (F.col("opcode").isNull() | (F.col("opcode") == F.col("_o")))
    hits = asked.join(n, same).groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"), F.min("pre").alias("_pre"))
    broken = trees.where("pre = -1").select(F.col(unit).alias("_broken")).distinct()
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    out = requests.join(hits, met, "left").join(broken, F.col(unit) == F.col("_broken"), "left")
    status = F.when(F.col("_broken").isNotNull(), "facts-malformed").when(F.col("_n") == 1, "found").when(F.col("_n") > 1, "ambiguous-target").otherwise("not-applicable")
    return out.select(*requests.columns, status.alias("status"), F.when(F.col("_n") == 1, F.col("_pre")).alias("pre"))


def next_of_kind(kind: str, unit: str) -> Column:
    """The number of the next node of a kind after each node: below it if it is at most its `last`."""
    later = Window.partitionBy(unit).orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    return F.min(F.when(F.col("kind") == kind, F.col("pre"))).over(later)


def function_declarations(trees: DataFrame, unit: str) -> DataFrame:
    """A row for every function declaration of node tables: unit, name, file, line, column, linkage ('internal' for
    static), definition (a body descends from it).  Of the same name at the same place the first counts."""
    rows = trees.where("pre >= 0").withColumn("_body", next_of_kind("CompoundStmt", unit)).where("kind = 'FunctionDecl'")
    linkage = F.when(F.col("storage") == "static", "internal").otherwise("external")
    out = rows.select(F.col(unit).alias("unit"), "name", "file", "line", "column", "pre", linkage.alias("linkage"), F.coalesce(F.col("_body") <= F.col("last"), F.lit(False)).alias("definition"))
    place = ["unit", "name", "file", "line", "column"]
    first = out.groupBy(*place).agg(F.min_by(F.struct("linkage", "definition"), "pre").alias("_f"))
    return first.select(*place, "_f.linkage", "_f.definition")
