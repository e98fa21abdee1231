"""The checkpoint of a whole search: what it was made from, and a run checkpoint inside, guarded by a fingerprint.

Little-endian: magic (8 bytes), version and integrity algorithm (u32), total
size and fingerprint (u64), six versions (u32), seed, generation and size of the
inner checkpoint (u64), ten texts (u64 size and bytes), the inner checkpoint.
The fingerprint is taken with its own field zero.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.fingerprint import fnv1a, fnv1a_many, text_form

MAGIC, VERSION, FNV1A64, HEADER, CHECK_AT = b"LODEPRD1", 1, 1, 80, 24
VERSIONS = ("catalogue_version", "recipe_version", "search_version", "mutation_version", "crossover_version", "repair_version")
NUMBERS = ("seed", "generation")
TEXTS = (
    "baseline_fingerprint", "analysis_fingerprint", "catalogue", "search_policy", "evaluation_provider", "orchestration_policy", "toolchain", "workload", "artifact_schema", "lineage_fingerprint",
)
IDENTITY = (*VERSIONS, *NUMBERS, *TEXTS)
_SCHEMA = ", ".join([*(f"{c} long" for c in (*VERSIONS, *NUMBERS)), *(f"{c} string" for c in TEXTS)])


class ProductError(ValueError):
    pass


def _check(identity: dict, limit: int) -> None:
    for c in VERSIONS:
        if not 0 < identity[c] < 1 << 32:
            raise ProductError("identity")
    for c in TEXTS:
        if not 0 < len((identity[c] or "").encode()) <= limit:
            raise ProductError("identity")


def _laid_out(identity: dict, checkpoint: bytes, max_text: int = 4096, max_bytes: int = 1 << 30) -> bytes:
    """A checkpoint whose fingerprint is still zero."""
    _check(identity, max_text)
    if not checkpoint:
        raise ProductError("checkpoint")
    body = struct.pack("<6I", *(identity[c] for c in VERSIONS)) + struct.pack("<3Q", *(identity[c] for c in NUMBERS), len(checkpoint))
    for c in TEXTS:
        raw = identity[c].encode()
        body += struct.pack("<Q", len(raw)) + raw
    body += checkpoint
    if 32 + len(body) > max_bytes:
        raise ProductError("size")
    return MAGIC + struct.pack("<IIQQ", VERSION, FNV1A64, 32 + len(body), 0) + body


def _with_check(raw: bytes, check: int) -> bytes:
    return raw[:CHECK_AT] + struct.pack("<Q", check) + raw[CHECK_AT + 8 :]


def create(identity: dict, checkpoint: bytes, max_text: int = 4096, max_bytes: int = 1 << 30) -> bytes:
    raw = _laid_out(identity, checkpoint, max_text, max_bytes)
    return _with_check(raw, fnv1a(raw))


def parse(raw: bytes, max_text: int = 4096, found: int | None = None) -> tuple[dict, bytes, str]:
    """(identity, inner checkpoint, fingerprint); anything that create() does not write is an error.

    found: the fingerprint of raw with its own field zero, where it is known already.
    """
    if len(raw) < HEADER or raw[:8] != MAGIC:
        raise ProductError("format")
    version, algorithm, total, check = struct.unpack_from("<IIQQ", raw, 8)
    if (version, algorithm, total) != (VERSION, FNV1A64, len(raw)):
        raise ProductError("format")
    if (fnv1a(_with_check(raw, 0)) if found is None else found) != check:
        raise ProductError("integrity")
    identity: dict = dict(zip(VERSIONS, struct.unpack_from("<6I", raw, 32)))
    *numbers, inner = struct.unpack_from("<3Q", raw, 56)
    identity |= dict(zip(NUMBERS, numbers))
    at = HEADER
    for c in TEXTS:
        if at + 8 > len(raw):
            raise ProductError("format")
        (size,) = struct.unpack_from("<Q", raw, at)
        if not 0 < size <= max_text or at + 8 + size > len(raw):
            raise ProductError("format")
        try:
            identity[c] = raw[at + 8 : at + 8 + size].decode()
        except UnicodeDecodeError:
            raise ProductError("format") from None
        at += 8 + size
    if not inner or at + inner != len(raw):
        raise ProductError("format")
    _check(identity, max_text)
    return identity, raw[at:], text_form(check)


def created(rows: DataFrame, name: str = "product") -> DataFrame:
    """Adds the binary column `name` to rows of the columns IDENTITY and `checkpoint` (binary); null where they are refused."""

    def run(parts):
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                try:
                    out.append(_laid_out(row, bytes(row["checkpoint"])))
                except ProductError:
                    out.append(None)
            marks = iter(fnv1a_many([raw for raw in out if raw is not None]))
            out = [None if raw is None else _with_check(raw, next(marks)) for raw in out]
            yield part.assign(**{name: pd.Series(out, index=part.index, dtype=object)})

    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {name} binary")


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """Adds IDENTITY, checkpoint, product_fingerprint and problem to rows with a binary column."""
    kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def run(parts):
        for part in parts:
            out, raws = [], [bytes(raw) for raw in part[column]]
            for raw, found in zip(raws, fnv1a_many([_with_check(raw, 0) for raw in raws])):
                try:
                    identity, inner, mark = parse(raw, found=found)
                    out.append({**identity, "checkpoint": inner, "product_fingerprint": mark, "problem": None})
                except ProductError as e:
                    out.append({"problem": str(e)})
            more = pd.DataFrame(out, columns=[*IDENTITY, "checkpoint", "product_fingerprint", "problem"], index=part.index, dtype=object)
            yield pd.concat([part, more], axis=1)

    return rows.mapInPandas(run, f"{kept}, {_SCHEMA}, checkpoint binary, product_fingerprint string, problem string")


def same_identity(a: str, b: str) -> Column:
    """Whether the IDENTITY columns of two aliases are all the same."""
    out = F.lit(True)
    for c in IDENTITY:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def validated(rows: DataFrame, column: str, expected: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, problem, the columns of rows to keep): null for a checkpoint that is sound and of the expected(key, IDENTITY); else format, integrity,
    identity, or identity-mismatch."""
    found = parsed(rows.select(key, column, *keep), column).alias("f")
    both = found.join(expected.alias("e"), F.col(f"f.{key}") == F.col(f"e.{key}"), "left")
    return both.select(F.col(f"f.{key}").alias(key), F.when(F.col("f.problem").isNotNull(), F.col("f.problem")).when(~same_identity("f", "e"), "identity-mismatch").alias("problem"), *[F.col(f"f.{c}") for c in keep])
