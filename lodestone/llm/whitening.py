"""Whitening of embeddings: covariance by Chan merging, principal components, whitened coordinates.

Every partition computes count, exact sums, local mean and centred scatter of
its vectors; pairs of such summaries merge by Chan's formula in a treeReduce, so
the driver only ever holds a few of them.  It decomposes the covariance (eigh).
A second pass over the fit list summarises the whitened vectors in the same way
and states how far their covariance is from the identity.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, settle

COMPONENTS = 16
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Share of the total variance up to which a component counts as none.
NO_VARIANCE = 1e-13
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_ROWS = 4096


Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def summary(rows: np.ndarray) -> Summary:
    """Count, exact column sums, mean and centred scatter of some rows (at least one)."""
    n, whole = len(rows), rows.dtype.kind == "i"
    safe = not whole or int(np.abs(rows).max()) < (1 << 62) // n
    sums = rows.sum(axis=0) if safe else rows.astype(object).sum(axis=0)
    mean = (sums / n).astype(np.float64)
    centred = (rows - mean).astype(np.float64)
    return n, sums.astype(object) if whole else sums, mean, centred.T @ centred  # whole sums stay exact at any size


def merge(one: Summary, two: Summary) -> Summary:
    """The summary of both's rows together, by Chan's formula."""
    n, gap = one[0] + two[0], two[2] - one[2]
    scatter = one[3] + two[3] + np.outer(gap, gap) * (one[0] * two[0] / n)
    return n, one[1] + two[1], one[2] + gap * (two[0] / n), scatter


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summary_of(rows: DataFrame, width: int, transform) -> Summary:
    """summary() of transform(x) over all rows(x); rows must not be empty."""

    @lean
    def run(batches):
        state = None
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for k in range(0, len(x), _ROWS):
                new = summary(transform(x[k : k + _ROWS]))
                state = new if state is None else merge(state, new)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    parts = rows.select("x").mapInArrow(run, "state binary").rdd
    return parts.map(lambda r: pickle.loads(r["state"])).treeReduce(merge)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact: as longs where they cannot overflow, else as Python's whole numbers."""
    if not x.size or max(int(np.abs(x).max()) * n, max(abs(s) for s in sums)) < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _squares(deviation: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; None where it does not fit a long."""
    if deviation.dtype != object:
        largest = int(np.abs(deviation).max(initial=0))
        if largest * largest * deviation.shape[1] < 1 << 63:
            return (deviation * deviation).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (deviation.astype(object) ** 2).sum(axis=1)]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows of SCHEMA: each vector's coordinate on each component, by falling eigenvalue, over its standard deviation.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    dropped; of vectors of different lengths those of the most frequent length
    remain (ties: the longest).  The fit list is each distinct scaled vector
    once, so copies weigh nothing; every remaining row gets coordinates,
    repeated and null ids too.  There are at most `components` of them, and
    none for directions without variance: a fit list of one vector, like an
    empty table, gives no rows.  Entries beyond a long saturate.  Other columns
    are not read.  Signs of components are those of the decomposition.
    """
    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(F.coalesce((F.size("v") > 0) & finite, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    width = sizes["size"]
    limit = F.lit((1 << 63) - 1 - shift).cast("long")
    x = F.transform("v", lambda c: F.least(F.floor(c * scale), limit) + shift)
    rows = rows.where(F.size("v") == width).select("vec_id", x.alias("x"))
    fit = settle(rows.select("x").distinct())
    n, sums, _, scatter = summary_of(fit, width, lambda x: x)
    covariance = scatter / n
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    kept = [k for k in range(width - 1, -1, -1) if values[k] > NO_VARIANCE * trace][:components]
    if not kept:
        return spark.createDataFrame([], SCHEMA)
    matrix = vectors[:, kept] / np.sqrt(values[kept])
    share = values[kept] / trace
    project = lambda x: (_deviation(x, n, sums) / n).astype(np.float64) @ matrix
    error = float(np.abs(summary_of(fit, width, project)[3] / n - np.eye(len(kept))).max())
    numbers = np.arange(1, len(kept) + 1, dtype=np.int32)

    @lean
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                x, ids = _matrix(part.column("x"), width), part.column("vec_id")
                deviation, m, c = _deviation(x, n, sums), len(x), len(kept)
                each = pa.array(np.repeat(np.arange(m), c))
                total = m * c
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(each),
                        pa.array(np.tile(numbers, m)),
                        pa.array(np.full(total, n)),
                        pa.array(_squares(deviation), pa.int64()).take(each),
                        pa.array(((deviation / n).astype(np.float64) @ matrix).ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(total, error)),
                    ],
                    schema=_OUT,
                )

    return rows.mapInArrow(run, SCHEMA)
