"""Exact top-k search by exhaustive term-at-a-time accumulation.

A query row is sparse: its non-zero components are terms with weights.  A block
of candidates holds, for each term, the postings (rows and weights).  For each
term of the queries its weighted postings are scattered into dense score
arrays, one for each query; partition selection keeps each block's k best, and
a merge of the blocks' best keeps each task's.

Queries are taken in groups of bounded bytes.  A group goes to every task once,
the candidates are scanned where they lie and are never shuffled, and a task
hands on k rows for each query; a window over those ranks them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import lean, settle

SCALE = 256
#: Rows and components of a block of candidates at most (a longer vector is a block of its own).
BLOCK_ROWS, BLOCK_COMPONENTS = 4096, 1 << 20
#: Components (8 bytes each) and rows of a group of queries, about.
GROUP_COMPONENTS, GROUP_ROWS = 1 << 22, 1 << 16
#: Queries whose score arrays are filled together.
TOGETHER = 64


class Sparse:
    """Vectors as rows of (term, integer weight); zeros are not held."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.at, self.terms, self.weights = ids, at, terms, weights

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, i: int, j: int) -> Sparse:
        lo, hi = self.at[i], self.at[j]
        return Sparse(self.ids[i:j], self.at[i : j + 1] - lo, self.terms[lo:hi], self.weights[lo:hi])


def integers(ids: np.ndarray, lists: pa.ListArray) -> Sparse:
    """Rows that take part, in ascending id order, with floor(SCALE * x) of their components."""
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    used = np.maximum(size, 0)
    owner = np.repeat(np.arange(len(size)), used)
    ok = size >= 0
    ok[owner[~np.isfinite(values)]] = False
    term = np.arange(len(values)) - np.repeat(np.cumsum(used) - used, used)
    weight = np.floor(SCALE * np.where(ok[owner], values, 0.0))
    take = np.flatnonzero(ok[owner] & (weight != 0))
    rank = np.empty(len(size), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    rank[order] = np.arange(len(order))
    take = take[np.argsort(rank[owner[take]], kind="stable")]
    counts = np.bincount(rank[owner[take]], minlength=len(size))
    kept = ok[order]
    at = np.concatenate([[0], np.cumsum(counts[kept])])
    return Sparse(ids[order][kept], at, term[take], weight[take])


class Postings:
    """The rows of a block by term: for each term the places of its rows and their weights."""

    def __init__(self, rows: Sparse):
        self.ids, self.most = rows.ids, np.abs(rows.weights).max(initial=0)
        by_term = np.argsort(rows.terms, kind="stable")
        self.terms, first = np.unique(rows.terms[by_term], return_index=True)
        self.bounds = np.append(first, len(by_term)).tolist()
        self.places = np.repeat(np.arange(len(rows)), np.diff(rows.at))[by_term]
        self.weights = rows.weights[by_term]
        self.as_float = self.weights.astype(np.float32)


def accumulate(queries: Sparse, rows: Postings) -> np.ndarray:
    """(queries, rows) integer inner products, term by term."""
    most = np.add.reduceat(np.abs(queries.weights), queries.at[:-1][np.diff(queries.at) > 0]).max(initial=0) if len(queries.weights) else 0.0
    bound = most * rows.most
    # Doubles are exact to 2**53, floats to 2**24; beyond, Python's integers.
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    as_kind = lambda x: np.array([int(v) for v in x], dtype=object) if kind is object else x.astype(kind, copy=False)
    scores = np.zeros((len(queries), len(rows.ids)), dtype=kind)
    weights = rows.as_float if kind is np.float32 else as_kind(rows.weights)
    added = np.empty_like(scores)
    order = np.argsort(queries.terms, kind="stable")
    owner = np.repeat(np.arange(len(queries)), np.diff(queries.at))[order]
    terms, q_weights = queries.terms[order], as_kind(queries.weights[order])
    lo, hi = (np.searchsorted(terms, rows.terms, side=side).tolist() for side in ("left", "right"))
    for k, (c, d) in enumerate(zip(lo, hi)):
        if c == d:
            continue
        a, b = rows.bounds[k], rows.bounds[k + 1]
        using, mine, weight = owner[c:d], q_weights[c:d, None], weights[a:b]
        if b - a == len(rows.ids):  # a posting for every row: its places are all places, in order
            part = np.multiply(mine, weight[None], out=added[: d - c])
            if d - c == len(queries):
                scores += part
            else:
                scores[using] += part
        else:
            scores[using[:, None], rows.places[None, a:b]] += mine * weight[None]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending); ids ascend.  The query's own row is left out."""
    valid = np.flatnonzero(ids != own)
    if len(valid) <= k:
        return valid[np.lexsort((ids[valid], -scores[valid]))]
    s = scores[valid]
    least = np.partition(s, len(s) - k)[len(s) - k]
    above = np.flatnonzero(s > least)
    ties = np.flatnonzero(s == least)[: k - len(above)]
    place = valid[np.concatenate([above, ties])]
    return place[np.lexsort((ids[place], -scores[place]))]


def _blocks(batch: pa.RecordBatch):
    """Slices of a batch with at most BLOCK_ROWS rows and about BLOCK_COMPONENTS components."""
    size = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    i = 0
    while i < batch.num_rows:
        j = min(int(np.searchsorted(size, size[i] + BLOCK_COMPONENTS, side="right")) - 1, i + BLOCK_ROWS, batch.num_rows)
        j = max(j, i + 1)
        yield batch.slice(i, j - i)
        i = j


_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(shared, k: int):
    """Candidates -> for each query of the group the k best of this task's rows."""

    @lean
    def run(batches):
        queries = Sparse(*shared.value)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object))] * len(queries)
        for batch in batches:
            for block in _blocks(batch):
                rows = integers(block.column(0).to_numpy(zero_copy_only=False), block.column(1))
                if not len(rows):
                    continue
                rows = Postings(rows)
                for i in range(0, len(queries), TOGETHER):
                    some = queries.part(i, min(len(queries), i + TOGETHER))
                    for n, (own, s) in enumerate(zip(some.ids, accumulate(some, rows)), start=i):
                        place = select(s, rows.ids, own, k)
                        ids = np.concatenate([best[n][0], rows.ids[place]])
                        found = np.concatenate([best[n][1], [int(x) for x in s[place]]])
                        order = np.lexsort((ids, -found))[:k]
                        best[n] = ids[order], found[order]
        for i in range(0, len(queries), 4096):
            part = best[i : i + 4096]
            owners = np.repeat(queries.ids[i : i + 4096], [len(ids) for ids, _ in part])
            cells = [owners, np.concatenate([ids for ids, _ in part]), [x for _, found in part for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], schema=_SCHEMA)

    return run


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by integer inner product.

    is_query: a condition on vec_id.  Ties go to the smaller vec_id.  A vector
    that is null or holds a null or a non-finite component takes no part, nor
    does a row without vec_id.  A shorter vector counts as filled with zeros.
    Rows that share a vec_id are candidates each for itself, but never for a
    query of that id; equal query rows are one query, and an id with different
    query rows gets the k best of all of them.  Extra columns are ignored; no
    rows give no rows.  A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    asked = rows.where(is_query).distinct().withColumn("dealt", F.xxhash64("vec_id", "embedding"))
    n, components = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    groups = max(1, -(-n // GROUP_ROWS), -(-components // GROUP_COMPONENTS))
    asked = settle(asked) if groups > 1 else asked
    found = None
    for g in range(groups):
        table = asked.where(F.pmod("dealt", F.lit(groups)) == g).select("vec_id", "embedding").toArrow().combine_chunks()
        lists = table["embedding"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        group = integers(table["vec_id"].to_numpy(), lists)  # GROUP_COMPONENTS and GROUP_ROWS bound it
        shared = spark.sparkContext.broadcast((group.ids, group.at, group.terms, group.weights))
        best = rows.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        best = settle(best) if groups > 1 else best
        found = best if found is None else found.union(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
