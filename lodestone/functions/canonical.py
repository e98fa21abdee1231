"""Canonical bytes of records, as binary columns: what fingerprints of evidence are taken of.

A number is eight bytes, little-endian; a text its length as a number and its
UTF-8 bytes (null: empty); a flag the number 1 or 0; a double the text of 17
significant digits.  Rows of a relation follow their count, in a stated order.

A fingerprint of a document never needs the document in one place.  A run of
bytes turns a state h into h * P**n + c[h mod 256], and such summaries compose
(fingerprint.summary, compose), so tasks summarise their ranges of a document.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprint import applied, compose, crc32_combined, fnv1a, fnv1a_number, summary, text_form
from .text import double_text


def number(x: Column) -> Column:
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]))


def text(x: Column) -> Column:
    raw = F.encode(F.coalesce(x.cast("string"), F.lit("")), "utf-8")
    return F.concat(number(F.octet_length(raw)), raw)


def flag(x: Column) -> Column:
    return number(F.when(x, 1).otherwise(0))


def real(x: Column) -> Column:
    return text(double_text(x.cast("double")))


def texts(x: Column) -> Column:
    """An array of texts: its count, then each text."""
    return F.concat(number(F.size(x)), joined(F.transform(x, text)))


def joined(parts: Column) -> Column:
    """An array of binaries as one binary."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


#: Bytes of a document's run in a task up to which they travel as they are; beyond, as a summary of 2 KB.
RAW = 8192
#: Bytes that are summarised in one go.
GO = 1 << 20
_PARTS = "section int, part long, records long, size long, raw binary, table binary"


def rows(df: DataFrame, key: str, order: list[str], record: Column) -> DataFrame:
    """The records of one section of documents: key, what orders them (whole numbers before texts, then the record), record."""
    kinds = dict(df.dtypes)
    whole = [F.col(c).cast("long") for c in order if kinds[c] != "string"]
    words = [F.col(c) for c in order if kinds[c] == "string"]
    numbers, names = (F.array(*x).cast(f"array<{t}>") for x, t in ((whole, "long"), (words, "string")))
    return df.select(key, numbers.alias("_numbers"), names.alias("_names"), record.alias("_record"))


def _partial(batches):
    """Sorted (key, section, record) -> one row of _PARTS for each document's run of a section in this task."""
    part, state = TaskContext.get().partitionId() << 32, None
    done = []

    def close():
        nonlocal part
        key, section, records, pieces, _, whole = state
        raw = b"".join(pieces)
        if whole is None and len(raw) <= RAW:
            done.append((key, section, part, records, len(raw), raw, None))
        else:
            size, table = compose(whole, summary(raw)) if whole else summary(raw)
            done.append((key, section, part, records, size, None, table.astype("<u8").tobytes()))
        part += 1

    for batch in batches:
        for key, section, record in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state[0] != key or state[1] != section:
                if state is not None:
                    close()
                state = [key, section, 0, [], 0, None]
            state[2] += 1
            state[3].append(record)
            state[4] += len(record)
            if state[4] >= GO:
                done_so_far = summary(b"".join(state[3]))
                state[3:] = [], 0, compose(state[5], done_so_far) if state[5] else done_so_far
        if done:
            yield _batch(done, batch.schema.field(0).type)
            done = []
    if state is not None:
        close()
        yield _batch(done, batch.schema.field(0).type)


def _batch(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    types = (key, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ("_key", "section", "part", "records", "size", "raw", "table")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


def partials(sections: list[DataFrame | None], key: str) -> DataFrame:
    """(_key, parts): summaries of all runs of a document's sections, in order.

    Records are dealt by range over (key, section, order), so a document may
    span any number of tasks; each task gives at most one summary for each
    document and section that it has rows of.
    """
    parts = [s.select(F.col(key).alias("_key"), F.lit(k).alias("_section"), "_numbers", "_names", "_record") for k, s in enumerate(sections) if s is not None]
    order = ["_key", "_section", "_numbers", "_names", "_record"]
    dealt = reduce(DataFrame.unionByName, parts).repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_section", "_record")
    out = dealt.mapInArrow(_partial, f"_key {dict(dealt.dtypes)['_key']}, {_PARTS}")
    return out.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("section", "part", "records", "size", "raw", "table"))).alias("_parts"))


def fingerprints(heads: DataFrame, key: str, sections: list[DataFrame | None], tail: str | None = None, uncounted: tuple[int, ...] = ()) -> DataFrame:
    """(key, fingerprint) of documents: heads(key, head[, tail]), and between head and tail the sections of rows(), each
    one's records in order after their count (but for the sections numbered in `uncounted`).  A section that is None or
    has no records of a document counts none.

    Documents are of any size: see `partials`.
    """
    n = len(sections)
    out = heads.select(key, "head", (F.col(tail) if tail else F.lit(None).cast("binary")).alias("_tail"))
    some = [s for s in sections if s is not None]
    if some:
        out = out.join(partials(sections, key), F.col(key).eqNullSafe(F.col("_key")), "left")
    else:
        out = out.withColumn("_parts", F.lit(None).cast("array<struct<" + _PARTS.replace(" ", ":").replace(",:", ",") + ">>"))

    @F.pandas_udf("string")
    def folded(head: pd.Series, parts: pd.Series, tail: pd.Series) -> pd.Series:
        def one(first, found, last):
            state = fnv1a(bytes(first))
            found = [] if found is None else found
            for section in range(n):
                mine = [p for p in found if p["section"] == section]
                if section not in uncounted:
                    state = fnv1a_number(sum(p["records"] for p in mine), state)
                for p in mine:
                    if p["raw"] is not None:
                        state = fnv1a(bytes(p["raw"]), state)
                    else:
                        state = applied(state, (p["size"], np.frombuffer(p["table"], dtype="<u8")))
            return text_form(state if last is None else fnv1a(bytes(last), state))

        return pd.Series([one(*x) for x in zip(head, parts, tail)], index=head.index, dtype=object)

    return out.select(key, folded("head", "_parts", "_tail").alias("fingerprint"))


def checksums(df: DataFrame, key: str, order: list[str], data: Column) -> DataFrame:
    """(key, size, crc32) of payloads that come in chunks, in order: each task sums up its runs, which are then combined."""

    def run(batches):
        part, state, done = TaskContext.get().partitionId() << 32, None, []
        for batch in batches:
            for k, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != k:
                    state = [k, part + len(done), 0, 0]
                    done.append(state)
                state[2], state[3] = state[2] + len(chunk), zlib.crc32(chunk, state[3])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()))], names=["_key", "part", "size", "crc"])

    order_by = ["_key", "_numbers", "_names", "_record"]
    rows_ = rows(df, key, order, data).withColumnRenamed(key, "_key").repartitionByRange(*order_by).sortWithinPartitions(*order_by).select("_key", "_record")
    runs = rows_.mapInArrow(run, f"_key {dict(rows_.dtypes)['_key']}, part long, size long, crc long")
    parts = runs.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("part", "size", "crc"))).alias("_parts"), F.sum("size").alias("size"))

    @F.pandas_udf("long")
    def combined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda found: reduce(lambda crc, p: crc32_combined(crc, p["crc"], p["size"]), found, 0))

    return parts.select(F.col("_key").alias(key), "size", combined("_parts").alias("crc32"))
