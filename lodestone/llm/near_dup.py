"""MinHash near-duplicate classes by min-max hashing.

Each permutation is evaluated once and gives two signature values, its minimum
and its maximum, so 64 evaluations give 128 values.  They are banded by four
(32 bands): a pair at Jaccard 0.75 shares no band with probability 5e-6.

Texts with equal word sequences are one class from the start, by a 128-bit
digest of the words.  Links are confirmed on the full shingle sets, hashed with
another seed than the signatures, so that no pair is linked by one clash.  In a
bucket, members are first compared with the bucket's smallest id alone; after
connected components only members that are still in different components are
compared, in large buckets block by block inside tasks, so a large group is
never expanded into rows of all its pairs, yet every pair that shares a bucket
is either compared or already connected.  Blocks are bounded by rows and by
shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import lean, settle, texts

PERMUTATIONS = 64
ROWS_PER_BAND = 4
BANDS = 2 * PERMUTATIONS // ROWS_PER_BAND
SHINGLE = 5
#: Exact share of common shingles that links two documents: 100*|A&B| >= PERCENT*|A|B|.
PERCENT = 75
#: Mixed buckets of at most so many members are compared pair by pair.
SMALL_BUCKET = 8
#: Members of a larger bucket that meet in one task: of the minor components, and of all.
BLOCK_MINOR, BLOCK_ALL = 500, 1000
#: Shingles of the members that meet in one task, about (a longer text is a block of its own).
BLOCK_SHINGLES = 1 << 18
#: Seeds of the hashes that make signatures and of those that confirm links.
SIGN_SEED, CONFIRM_SEED = 0, 1
_PERM = B.mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_SIGN = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, seed: int = SIGN_SEED):
    """Per text: the sorted distinct shingle hashes, as one array and n+1 offsets."""
    values, ends = [], [np.zeros(1, dtype=np.int64)]
    for i, j in B.steps(offsets):
        hashes, at = B.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], seed)
        part, at = B.unique_per_text(*B.shingle_hashes(hashes, at, size))
        values.append(part)
        ends.append(at[1:] + ends[-1][-1])
    return (np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)), np.concatenate(ends)


def band_hashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64; texts without shingles are not allowed here."""
    sig = np.empty((len(at) - 1, 2 * PERMUTATIONS), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        x = values * _PERM[p]
        sig[:, 2 * p] = np.minimum.reduceat(x, at[:-1])
        sig[:, 2 * p + 1] = np.maximum.reduceat(x, at[:-1])
    sig = sig.reshape(len(sig), BANDS, ROWS_PER_BAND)
    mixed = B.mix64((B.mix64(sig) * B._PLACE[:ROWS_PER_BAND]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return mixed.view(np.int64)


def word_digest(text: bytes) -> bytes:
    """128 bits that tell word sequences apart, whatever white space is between the words."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()  # bytes.lower and split: ASCII alone


@lean
def _sign(batches):
    for batch in batches:
        ids = batch.column(0)
        data, off = B.column_bytes(batch.column(1))
        for i, j in B.steps(off):
            values, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            counts = np.diff(at)
            full = np.flatnonzero(counts)
            digests = [word_digest(data[off[i + k] : off[i + k + 1]].tobytes()) if counts[k] else None for k in range(j - i)]
            bands = np.zeros((0, BANDS), dtype=np.int64)
            if len(full):
                bands = band_hashes(values, np.concatenate([at[full], at[-1:]]))
            lens = np.where(counts > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], schema=_SIGN)


@lean
def _confirm(batches):
    """Rows (a, b, text_a, text_b), those of one `a` together where possible -> (a, b) that are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    last, left = None, None
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data_b, off_b = B.column_bytes(batch.column(3))
        keep = np.zeros(len(a), dtype=bool)
        for i, j in B.steps(off_b):
            values, at = shingle_sets(data_b[off_b[i] : off_b[j]], off_b[i : j + 1] - off_b[i], seed=CONFIRM_SEED)
            for k in range(i, j):
                raw = (batch.column(2)[k].as_py() or "").encode()
                if last != (a[k], raw):  # rows of one id may differ in their texts
                    left = shingle_sets(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), seed=CONFIRM_SEED)[0]
                    last = (a[k], raw)
                right = values[at[k - i] : at[k - i + 1]]
                if 100 * min(len(left), len(right)) < PERCENT * max(len(left), len(right)):
                    continue
                small, large = (left, right) if len(left) < len(right) else (right, left)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[place] == small).sum())
                keep[k] = 100 * both >= PERCENT * (len(left) + len(right) - both)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], schema=schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for every node of an edge.

    Each round gives every node the smallest label among its neighbours', then
    jumps to that label's own label; rounds go on until no label changes.  All
    steps are joins and aggregations.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = settle(labels)
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(around, labels.node == around.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = settle(near.join(jump, near.c == jump.via, "left").select("node", "old", F.least("c", F.coalesce("far", "c")).alias("component")))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets reach the threshold."""
    other = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    # The texts of `a` meet the pairs in a sort-merge join, which Spark splits where one `a` has many.
    mine = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    rows = other.join(mine.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_confirm, "a long, b long")


def _common(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """(left texts, right texts) numbers of common shingles: products of 0/1 matrices, a few thousand shingles at a time."""
    shared = np.intersect1d(left, right)
    out = np.zeros((len(left_at) - 1, len(right_at) - 1), dtype=np.float32)
    sides = []
    for values, at in ((left, left_at), (right, right_at)):
        place = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        use = shared[place] == values if len(shared) else np.zeros(len(values), dtype=bool)
        place, owner = place[use], np.repeat(np.arange(len(at) - 1), np.diff(at))[use]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], owner[order]))
    for first in range(0, len(shared), 2048):
        cells = []
        for (place, owner), n in zip(sides, out.shape):
            lo, hi = np.searchsorted(place, [first, first + 2048])
            cell = np.zeros((n, 2048), dtype=np.float32)
            cell[owner[lo:hi], place[lo:hi] - first] = 1
            cells.append(cell)
        out += cells[0] @ cells[1].T
    return out.astype(np.int64)


def _meet(table: pa.Table) -> pa.Table:
    """Links between the `minor` rows of a block and all its other rows, by exact intersection counts."""
    data, off = B.column_bytes(table["text"])
    values, at = shingle_sets(data, off, seed=CONFIRM_SEED)
    minor = table["minor"].to_numpy().astype(bool)
    ids, part = table["doc_id"].to_numpy(), table["part"].to_numpy()
    row, col = np.flatnonzero(minor), np.flatnonzero(~minor)
    sides = []
    for pick in (row, col):
        sides += [np.concatenate([values[:0], *(values[at[k] : at[k + 1]] for k in pick)]), np.concatenate([[0], np.cumsum(np.diff(at)[pick])])]
    both = _common(*sides)
    size = np.diff(at)
    hit = 100 * both >= PERCENT * (size[row][:, None] + size[col][None, :] - both)
    hit &= part[row][:, None] != part[col][None, :]
    i, j = np.nonzero(hit)
    return pa.table({"a": pa.array(ids[row[i]], pa.int64()), "b": pa.array(ids[col[j]], pa.int64())})


def _linked_in_blocks(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links across components within buckets: the members outside a bucket's largest component meet all members."""
    near = F.xxhash64("doc_id")
    n_minor = F.ceil(F.greatest((F.col("m") - F.col("top")) / BLOCK_MINOR, F.col("minor_shingles") / BLOCK_SHINGLES))
    n_all = F.ceil(F.greatest(F.col("m") / BLOCK_ALL, F.col("all_shingles") / BLOCK_SHINGLES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    base = members.withColumn("n_minor", n_minor).withColumn("n_all", n_all)
    a = base.select("bucket", F.pmod(near, "n_all").alias("block"), every(F.col("n_minor")).alias("minor_block"), F.lit(False).alias("minor"), "doc_id", "part")
    r = base.where("part <> major").select("bucket", every(F.col("n_all")).alias("block"), F.pmod(near, "n_minor").alias("minor_block"), F.lit(True).alias("minor"), "doc_id", "part")
    rows = a.unionByName(r).join(docs.select("doc_id", "text").hint("merge"), "doc_id")
    return rows.groupBy("bucket", "minor_block", "block").applyInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A null text, an empty one or one of white space alone has n_shingles 0 and
    is its own component.  Rows with the same doc_id are one node of the graph:
    equal rows stay separate rows, and so do rows with different texts.  A row
    without doc_id is linked with nothing, has no component and is kept.  Extra
    columns of docs are ignored.  No rows give no rows.
    """
    return _classes(texts(docs))[0]


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of near_duplicates(), and (settled) the signatures of all rows."""
    signs = settle(docs.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, bands array<long>"))
    full = signs.where("n_shingles > 0 and doc_id is not null")
    classes = settle(full.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes.select("rep", F.col("digest").alias("d")), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("d")), "left_semi")
    rows = settle(reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket")))
    heads = rows.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").drop("tail")
    buckets = settle(rows.join(heads, "bucket"))
    # Only documents that share a bucket are ever compared: their texts alone are shuffled from here on.
    met = docs.join(buckets.select(F.col("doc_id").alias("_met")).distinct(), F.col("doc_id") == F.col("_met"), "left_semi")
    docs = settle(met)
    star = buckets.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    # Texts of one id are one node whatever they are: the chain from each class to the others goes over its id.
    same = full.join(classes, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    many = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("_many"))
    bridges = same.join(many, F.col("b") == F.col("_many"), "left_semi")
    links = settle(_linked(star, docs).union(bridges))
    found = connected_components(links)

    # What shares a bucket and is still apart is compared too: in small buckets pair by pair, in large
    # ones block by block inside tasks, which hand on confirmed links alone.
    of = found.select("node", "component")
    placed = buckets.join(of, buckets.doc_id == of.node, "left").select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("part"))
    parts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    largest = F.max(F.struct("c", "part", "s"))
    mixed = parts.groupBy("bucket").agg(F.sum("c").alias("m"), F.sum("s").alias("all_shingles"), largest.alias("major")).where("major.c < m")
    mixed = mixed.select("bucket", "m", "all_shingles", F.col("major.c").alias("top"), F.col("major.part").alias("major"), (F.col("all_shingles") - F.col("major.s")).alias("minor_shingles"))
    apart = settle(placed.join(mixed, "bucket"))
    small = apart.where(F.col("m") <= SMALL_BUCKET)
    x = small.select("bucket", F.col("doc_id").alias("a"), F.col("part").alias("pa"))
    y = small.select("bucket", F.col("doc_id").alias("b"), F.col("part").alias("pb"))
    rest = x.join(y, "bucket").where("a < b and pa <> pb").select("a", "b").distinct()
    more = settle(_linked(rest, docs).union(_linked_in_blocks(apart.where(F.col("m") > SMALL_BUCKET), docs)))
    if not more.isEmpty():
        found = connected_components(links.union(more))

    of_class = classes.join(found, classes.rep == found.node, "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("c"))
    out = signs.join(of_class, (signs.digest == of_class.d) & signs.doc_id.isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), signs


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all its columns as they were.

    The smallest doc_id of a component stays.  Of rows with the same doc_id and
    the same text one stays; rows of one doc_id with different texts all stay
    or all go.  Rows without doc_id stay.  No rows give no rows.
    """
    slim = texts(docs)
    found, signs = _classes(slim)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs.doc_id.cast("long") == gone._gone, "left_anti")
    # Rows that repeat are few ids or many of one id: only they are grouped by their text.
    twice = settle(signs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")))
    if twice.isEmpty():
        return left
    once = left.join(twice, left.doc_id.cast("long") == twice._twice, "left_anti")
    again = left.join(twice, left.doc_id.cast("long") == twice._twice, "left_semi")
    return once.union(again.dropDuplicates(["doc_id", "text"]))
