"""Source trees as a data source: a row for each regular file below the permitted roots, read in parallel.

The driver lists names and sizes alone and checks every budget; only then are
partitions of about PART bytes handed out, and tasks open the files.  Hidden
files count, links and special files are refused, as are a tree without files
and roots that overlap.  Comparisons of `path` and `size` with constants prune
files before they are opened: read_tree() lets the session's Python sources see
filters (spark.sql.python.filterPushdown.enabled), which they need for that.
"""

from __future__ import annotations

import json
import os
import stat
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

FORMAT = "lodestone-tree"
#: Bytes of a partition, about, and of a batch.
PART, BATCH = 64 << 20, 8 << 20
SCHEMA = "path string, size long, content binary"
BUDGETS = ("max_files", "max_file_bytes", "max_total_bytes", "max_path_bytes")


class TreeError(ValueError):
    """path, file-missing, link, empty, overlap, or the name of a budget; then what breaks the rule."""


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int]]


def listed(root: str, roots: list[str], budgets: dict[str, int]) -> list[tuple[str, int]]:
    """(path relative to root, size) of every file, in byte order of paths; TreeError for what breaks a rule."""
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    out: list[tuple[str, int]] = []
    total = 0

    def add(path: str, size: int) -> None:
        nonlocal total
        total += size
        out.append((path, size))
        over = {"max_files": len(out), "max_file_bytes": size, "max_total_bytes": total, "max_path_bytes": len(path.encode())}
        for name in BUDGETS:
            if name in budgets and over[name] > budgets[name]:
                raise TreeError(f"{name}: {path}")

    def walk_local(path: str) -> None:
        full = os.path.join(base, path)
        try:
            mode = os.lstat(full)
        except OSError:
            raise TreeError(f"file-missing: {path}") from None
        if stat.S_ISREG(mode.st_mode):
            add(path, mode.st_size)
        elif stat.S_ISDIR(mode.st_mode):
            for name in sorted(os.listdir(full)):
                walk_local(f"{path}/{name}" if path != "." else name)
        else:
            raise TreeError(f"link: {path}")

    def walk_store(path: str) -> None:
        full = base if path == "." else f"{base}/{path}"
        info = system.get_file_info(full)
        if info.type == fs.FileType.NotFound:
            raise TreeError(f"file-missing: {path}")
        for found in [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(full, recursive=True)):
            if found.type == fs.FileType.File:
                add(found.path[len(base) + 1 :], found.size)

    for r in roots:
        if r != "." and (r.startswith("/") or any(part in ("", ".", "..") for part in r.split("/"))):
            raise TreeError(f"path: {r}")
        (walk_local if isinstance(system, fs.LocalFileSystem) else walk_store)(r)
    if not out:
        raise TreeError(f"empty: {root}")
    out.sort(key=lambda f: f[0].encode())
    for one, two in zip(out, out[1:]):
        if one[0] == two[0]:
            raise TreeError(f"overlap: {one[0]}")
    return out


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.roots = json.loads(options.get("roots", '["."]'))
        self.budgets = {b: int(options[b]) for b in BUDGETS if b in options}
        self.keep: list = []

    def pushFilters(self, filters):
        """Comparisons of path and size prune the list; the rest stays with Spark."""
        kinds = (EqualTo, In, StringStartsWith, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)
        for f in filters:
            if isinstance(f, kinds) and f.attribute in (("path",), ("size",)) and not (isinstance(f, StringStartsWith) and f.attribute == ("size",)):
                self.keep.append(f)
            else:
                yield f

    def _kept(self, path: str, size: int) -> bool:
        for f in self.keep:
            x, y = (path, f.value) if f.attribute == ("path",) else (size, f.value)
            if isinstance(x, str) and isinstance(y, str):
                x, y = x.encode(), y.encode()
            fine = (
                isinstance(f, EqualTo) and x == y
                or isinstance(f, In) and any(x == (v.encode() if isinstance(v, str) else v) for v in f.value)
                or isinstance(f, StringStartsWith) and x.startswith(y)
                or isinstance(f, LessThan) and x < y or isinstance(f, LessThanOrEqual) and x <= y or isinstance(f, GreaterThan) and x > y or isinstance(f, GreaterThanOrEqual) and x >= y
            )
            if not fine:
                return False
        return True

    def partitions(self):
        files = [f for f in listed(self.root, self.roots, self.budgets) if self._kept(*f)]
        out, held = [], 0
        for path, size in files:
            if not out or held + size > PART or len(out[-1].files) >= 1000:
                out.append(Part([]))
                held = 0
            out[-1].files.append((path, size))
            held += size
        return out or [Part([])]

    def read(self, partition):
        system, base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), os.path.abspath(self.root))
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        rows, held = [], 0
        for path, size in partition.files:
            with system.open_input_stream(f"{base}/{path}") as stream:
                content = stream.read()
            if len(content) != size:
                raise TreeError(f"changed while it was read: {path}")
            rows.append((path, size, content))
            held += size
            if held >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, roots: list[str] | None = None, **budgets: int) -> DataFrame:
    """(path, size, content) of every file below root (a path that all tasks see, or the URI of a store that pyarrow
    opens); budgets: see BUDGETS."""
    root = f"file:///{root[5:].lstrip('/')}" if root.startswith("file:/") else root
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    options = {"root": root, "roots": json.dumps(roots or ["."]), **{k: str(v) for k, v in budgets.items()}}
    return spark.read.format(FORMAT).options(**options).load()
