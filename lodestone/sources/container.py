"""A binary checkpoint container: header, six contiguous sections, CRC-32 over everything with its own field blank.

All numbers are little-endian: magic (8 bytes), version and header size (u32),
total size (u64), six (offset, size) pairs (u64), configuration fingerprint
(u64), integrity algorithm, CRC-32, section count and zero (u32 each).
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.fingerprint import fnv1a

MAGIC, VERSION, HEADER, CRC_AT = b"LODECKP1", 1, 144, 132
SECTIONS = ("configuration", "state", "statistics", "evaluations", "genomes", "best_genome")


class ContainerError(ValueError):
    pass


def size(sections: dict[str, bytes]) -> int:
    return HEADER + sum(len(sections[s]) for s in SECTIONS)


def encode(sections: dict[str, bytes], magic: bytes = MAGIC) -> bytes:
    at, pairs = HEADER, []
    for s in SECTIONS:
        pairs += [at, len(sections[s])]
        at += len(sections[s])
    head = magic + struct.pack("<IIQ", VERSION, HEADER, at) + struct.pack("<12Q", *pairs) + struct.pack("<QIIII", fnv1a(sections["configuration"]), 1, 0, len(SECTIONS), 0)
    raw = bytearray(head + b"".join(sections[s] for s in SECTIONS))
    raw[CRC_AT : CRC_AT + 4] = struct.pack("<I", zlib.crc32(bytes(raw)))
    return bytes(raw)


def decode(raw: bytes, magic: bytes = MAGIC) -> dict[str, bytes]:
    """The sections; anything that is not exactly what encode() writes is an error."""
    if len(raw) < HEADER or raw[:8] != magic:
        raise ContainerError("magic")
    version, header, total = struct.unpack_from("<IIQ", raw, 8)
    if (version, header, total) != (VERSION, HEADER, len(raw)):
        raise ContainerError("header")
    pairs = struct.unpack_from("<12Q", raw, 24)
    config, algorithm, crc, count, zero = struct.unpack_from("<QIIII", raw, 120)
    if (algorithm, count, zero) != (1, len(SECTIONS), 0):
        raise ContainerError("header")
    if zlib.crc32(raw[:CRC_AT] + bytes(4) + raw[CRC_AT + 4 :]) != crc:
        raise ContainerError("checksum")
    out, at = {}, HEADER
    for k, s in enumerate(SECTIONS):
        if pairs[2 * k] != at:
            raise ContainerError("sections")
        out[s] = raw[at : at + pairs[2 * k + 1]]
        at += pairs[2 * k + 1]
    if at != total or fnv1a(out["configuration"]) != config:
        raise ContainerError("configuration")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, problem, and the sections of each container file as binary columns; damaged files have a problem."""

    def run(parts):
        for part in parts:
            rows = []
            for p, raw in zip(part["path"], part["content"]):
                try:
                    got = decode(bytes(raw))
                    rows.append((p, None, *(got[s] for s in SECTIONS)))
                except ContainerError as e:
                    rows.append((p, str(e), *[None] * len(SECTIONS)))
            yield pd.DataFrame(rows, columns=["path", "problem", *SECTIONS])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, problem string, " + ", ".join(f"{s} binary" for s in SECTIONS))


#: One candidate of the section `evaluations`: valid, evaluated (a byte each), and seven components (doubles).
CANDIDATE = "<??7d"
COMPONENTS = ("correctness", "performance", "memory_use", "reliability", "maintainability", "constraint_penalty", "total")


def candidates(df: DataFrame, column: str, genome_size: int) -> DataFrame:
    """One row per candidate of each checkpoint: the other columns, population_index, valid, evaluated, the components and genome.

    A checkpoint whose sections do not hold whole candidates is an error.
    """
    kept = [c for c in df.columns if c != column]
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "population_index long", "valid boolean", "evaluated boolean", *(f"{c} double" for c in COMPONENTS), "genome binary"])

    size = struct.calcsize(CANDIDATE)

    def run(parts):
        for part in parts:
            rows = []
            for head, raw in zip(part[kept].itertuples(index=False), part[column]):
                sections = decode(bytes(raw))
                told, genomes = sections["evaluations"], sections["genomes"]
                n, left = divmod(len(told), size)
                if left or len(genomes) != n * genome_size:
                    raise ContainerError("candidates")
                rows += [(*head, i, *struct.unpack_from(CANDIDATE, told, i * size), genomes[i * genome_size : (i + 1) * genome_size]) for i in range(n)]
            yield pd.DataFrame(rows, columns=[*kept, "population_index", "valid", "evaluated", *COMPONENTS, "genome"])

    return df.mapInPandas(run, schema)
