"""Source edits on byte ranges, patches, and the records of what changed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.fingerprint import fnv1a, text_form

def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files(path, content) and edits(path, start, end, before, after, identity) -> the new contents.

    Edits of a file are sorted by start, then identity; they must not overlap and
    must find their `before` bytes.  Result: path, content, status ('unchanged',
    'changed', 'overlap', 'mismatch' or 'range'), edit_count, and size and
    fingerprint before and after.  A failed file keeps its content.
    """
    packed = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "identity", "end", "before", "after"))).alias("edits"))  # one file's edits
    rows = files.select("path", "content").join(packed, "path", "left")

    def run(parts):
        for part in parts:
            out = []
            for path, content, todo in zip(part["path"], part["content"], part["edits"]):
                content, todo = bytes(content), [] if todo is None else list(todo)
                status, at, pieces = "changed" if todo else "unchanged", 0, []
                for e in todo:
                    if not 0 <= e["start"] <= e["end"] <= len(content):
                        status = "range"
                    elif e["start"] < at:
                        status = "overlap"
                    elif content[e["start"] : e["end"]] != bytes(e["before"]):
                        status = "mismatch"
                    else:
                        pieces += [content[at : e["start"]], bytes(e["after"])]
                        at = e["end"]
                        continue
                    break
                new = b"".join([*pieces, content[at:]]) if status == "changed" else content
                out.append((path, new, status, len(todo), len(content), len(new), text_form(fnv1a(content)), text_form(fnv1a(new))))
            yield pd.DataFrame(out, columns=["path", "content", "status", "edit_count", "before_size", "after_size", "before_fingerprint", "after_fingerprint"])

    return rows.mapInPandas(run, "path string, content binary, status string, edit_count long, before_size long, after_size long, before_fingerprint string, after_fingerprint string")


# The line forms of a unified patch.
def whole_file_patch(path: Column, before: Column, after: Column) -> Column:
    """One hunk: all old lines removed, all new lines added; a text without a last line end says so."""

    def side(text, sign):
        lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
        listed = F.array_join(F.transform(lines, lambda s: F.concat(F.lit(sign), s)), "\n")
        tail = F.when(text.endswith("\n"), "\n").otherwise("\n\\ No newline at end of file\n")
        return F.when(text == "", "").otherwise(F.concat(listed, tail))

    count = lambda t: F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\n\z", ""), "\n")))
    first = lambda t: F.when(t == "", "0").otherwise("1")
    span = lambda t: F.concat(first(t), F.lit(","), count(t).cast("string"))
    head = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -"), span(before), F.lit(" +"), span(after), F.lit(" @@\n"))
    return F.concat(head, side(before, "-"), side(after, "+"))


def application_status(records: DataFrame, applications: DataFrame, key: str) -> DataFrame:
    """For every record or application: 'matched', 'missing' (no application), 'duplicate' or 'unknown' (no record)."""
    n = applications.groupBy(key).agg(F.count(F.lit(1)).alias("applications"))
    both = records.select(key).distinct().withColumn("_known", F.lit(True)).join(n, key, "full_outer")
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("applications").isNull(), "missing").when(F.col("applications") > 1, "duplicate").otherwise("matched")
    return both.select(key, F.coalesce("applications", F.lit(0)).cast("long").alias("applications"), status.alias("status"))
