"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): all grades share one weight vector
over hashed text features and differ in ordered thresholds alone.  A document
gets its expected grade and the probability of at least grade `AT_LEAST`.

Features are shares of the whole text, so texts of all lengths compare: hashed
words and byte trigrams on a fixed table, and a few shape figures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import lean, sample_of_each, texts

BUCKETS = 1 << 16
SHAPE = 10
#: Shares are multiplied by this, so that weights of size 1 matter.
SCALE = 30.0
#: Rated rows of each grade that are learnt from at most, by hash order.
SAMPLE = 2000
RIDGE, EPOCHS, BATCH, RATE = 1e-4, 15, 256, 0.05
#: Features that fewer of the learnt rows have get no weight.
MIN_DOCS = 3
#: Documents are selected by P(grade >= AT_LEAST) >= SELECT.
AT_LEAST, SELECT = 1, 0.5

_CLASS = np.full(256, 3, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 other, 4 space
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[128:] = 0
_CLASS[[32, 9, 10, 11, 12, 13]] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share) of every word and byte trigram, repeats kept, and (texts, SHAPE) shape figures."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    shape = np.zeros((n, SHAPE))
    kind = _CLASS[data]
    shape[:, :5] = np.bincount(owner * 5 + kind, minlength=5 * n).reshape(n, 5) / np.maximum(1, size)[:, None]
    hashes, at = B.word_hashes(data, offsets)
    n_words = np.diff(at)
    word_owner = np.repeat(np.arange(n), n_words)
    per_word, per_byte = 1 / np.maximum(1, n_words), 1 / np.maximum(1, size)
    same = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    distinct = np.unique(word_owner.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24)) >> np.uint64(40)
    marks = (kind[1:] == 3) & (kind[:-1] == 3)
    shape[:, 5] = np.log1p(n_words) / 10
    shape[:, 6] = size * per_word / 50
    shape[:, 7] = np.bincount(word_owner[1:], weights=same, minlength=n) * per_word
    shape[:, 8] = np.bincount(distinct.astype(np.int64), minlength=n) * per_word
    shape[:, 9] = np.bincount(owner[1:], weights=marks, minlength=n) * per_byte
    half = BUCKETS // 2
    low = B.lower_ascii(data).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    tri = ((low[:-2] * 43020801 + low[1:-1] * 65599 + low[2:]) * 0x9E3779B1 >> 11 & (half - 1))[inside] + half
    tri_owner = owner[:-2][inside]
    ids = np.concatenate([(hashes & np.uint64(half - 1)).astype(np.int64), tri])
    rows = np.concatenate([word_owner, tri_owner])
    share = np.concatenate([per_word[word_owner], per_byte[tri_owner]]) * SCALE
    return rows, ids, share, shape


class Model:
    """Shared weights of buckets and shape figures, ordered thresholds; grade k is at most k where k < len(thresholds)."""

    def __init__(self, weights, shape_weights, thresholds):
        self.weights, self.shape_weights, self.thresholds = weights, shape_weights, thresholds

    def latent(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, ids, share, shape = features(data, offsets)
        return np.bincount(rows, weights=self.weights[ids] * share, minlength=len(offsets) - 1) + shape @ self.shape_weights

    def grades(self, latent: np.ndarray, at_least: int = AT_LEAST) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of at least a grade."""
        above = 1 - 1 / (1 + np.exp(-np.clip(self.thresholds[None] - latent[:, None], -40, 40)))
        tail = above[:, at_least - 1] if 1 <= at_least <= len(self.thresholds) else np.full(len(latent), float(at_least < 1))
        return above.sum(axis=1), tail


def fit(grade: np.ndarray, rows: np.ndarray, ids: np.ndarray, share: np.ndarray, shape: np.ndarray) -> Model:
    """Cumulative-link regression; grades are 0..K, `rows` ascend.  Thresholds are t0, t0 + exp(g1), ...: always in order.

    Adam on the negative log likelihood, a batch of rows at a time.
    """
    n, top = len(grade), int(grade.max()) if len(grade) else 0
    if n == 0 or top == 0:
        return Model(np.zeros(BUCKETS), np.zeros(SHAPE), np.array([0.0] if n == 0 else [40.0]))
    keep = np.bincount(ids, minlength=BUCKETS)[ids] >= min(MIN_DOCS, n)
    rows, ids, share = rows[keep], ids[keep], share[keep].astype(np.float32)
    # A random order of the rows, once; batches are then neighbouring rows.
    order = np.random.default_rng(5).permutation(n)
    sizes = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(sizes)])
    sizes = sizes[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    pick = np.repeat(first[order] - at[:-1], sizes) + np.arange(at[-1])
    used, col = np.unique(ids[pick], return_inverse=True)
    share, grade, shape = share[pick], grade[order], shape[order]
    owner = np.repeat(np.arange(n), sizes)
    share_of = [np.clip((grade <= k).mean(), 0.01, 0.99) for k in range(top)]
    start = np.maximum.accumulate(np.log(np.array(share_of) / (1 - np.array(share_of))) + 1e-3 * np.arange(top))
    p = {"w": np.zeros(len(used)), "s": np.zeros(SHAPE), "t": start[:1].copy(), "g": np.log(np.maximum(np.diff(start), 1e-3))}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    t = 0
    for epoch in range(EPOCHS):
        for i in range(0, n, BATCH):
            j = min(n, i + BATCH)
            lo, hi, y, x = at[i], at[j], grade[i:j], shape[i:j]
            c, r, f = col[lo:hi], owner[lo:hi] - i, share[lo:hi]
            th = p["t"][0] + np.concatenate([[0], np.cumsum(np.exp(p["g"]))])
            latent = np.bincount(r, weights=p["w"][c] * f, minlength=j - i) + x @ p["s"]
            edges = np.concatenate([[-np.inf], th, [np.inf]])
            up, low = sigmoid(edges[y + 1] - latent), sigmoid(edges[y] - latent)
            up[y == top], low[y == 0] = 1, 0
            prob = np.maximum(up - low, 1e-9) * (j - i)
            d_up, d_low = up * (1 - up) / prob, low * (1 - low) / prob  # of log P, by the upper and lower edge
            d_latent = d_up - d_low  # of the loss
            d_th = np.zeros(top)
            np.add.at(d_th, y[y < top], -d_up[y < top])
            np.add.at(d_th, y[y > 0] - 1, d_low[y > 0])
            tail = np.cumsum(d_th[::-1])[::-1]
            g = {
                "w": np.bincount(c, weights=d_latent[r] * f, minlength=len(used)) + RIDGE * p["w"],
                "s": x.T @ d_latent + RIDGE * p["s"],
                "t": tail[:1],
                "g": tail[1:] * np.exp(p["g"]),
            }
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = p["w"]
    return Model(weights, p["s"], p["t"][0] + np.concatenate([[0], np.cumsum(np.exp(p["g"]))]))


_ROW = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("ids", pa.list_(pa.int32())), ("share", pa.list_(pa.float32())), ("shape", pa.list_(pa.float32()))])


@lean
def _feature_rows(batches):
    for batch in batches:
        data, off = B.column_bytes(batch.column(2))
        for i, j in B.steps(off):
            rows, ids, share, shape = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            key, place = np.unique(rows * BUCKETS + ids, return_inverse=True)
            total = np.bincount(place, weights=share, minlength=len(key))
            ends = pa.array(np.searchsorted(key // BUCKETS, np.arange(j - i + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % BUCKETS).astype(np.int32), total.astype(np.float32))]
            shapes = pa.ListArray.from_arrays(pa.array((np.arange(j - i + 1) * SHAPE).astype(np.int32)), pa.array(shape.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).cast(pa.int32()), *lists, shapes], schema=_ROW)


def train(docs: DataFrame, ratings: DataFrame, grade, sample: int = SAMPLE) -> Model:
    """Fit on ratings (doc_id and the column expression `grade`, 0..9), `sample` rows of each grade at most."""
    rows = ratings.select(F.col("doc_id").cast("long").alias("rated"), grade.cast("int").alias("grade")).where("rated is not null and grade between 0 and 9")
    rows = rows.groupBy("rated").agg(F.min("grade").alias("grade"))
    few = sample_of_each(rows, "grade", "rated", sample)  # 10 * sample rows of two numbers at most
    chosen = texts(docs).join(F.broadcast(few), F.col("doc_id") == F.col("rated"))
    # One text for each id, however often the id repeats: what comes to the driver is bounded by the sample.
    chosen = chosen.groupBy("rated").agg(F.max("grade").alias("grade"), F.min("text").alias("text"))
    ddl = "doc_id long, grade int, ids array<int>, share array<float>, shape array<float>"
    got = chosen.mapInArrow(_feature_rows, ddl).toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fit(*[np.zeros(0, dtype=np.int64)] * 4, np.zeros((0, SHAPE)))
    ids = got["ids"].combine_chunks()
    rows_of = np.repeat(np.arange(got.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
    flat = [got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "share", "shape")]
    return fit(got["grade"].to_numpy().astype(np.int64), rows_of, flat[0].astype(np.int64), flat[1].astype(np.float64), flat[2].reshape(-1, SHAPE).astype(np.float64))


def _scorer(model: Model):
    @lean
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64())])
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            for i, j in B.steps(off):
                grades, tail = model.grades(model.latent(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(grades), pa.array(tail)], schema=schema)

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept for every row of docs.

    Grades come from labels: 0 where quality is 0, 1 where quality is 1 and
    toxic is 1, 2 where quality is 1 and toxic is not (a null toxic counts as
    not; rows with another or no quality are not learnt from); a document rated
    several times has its lowest grade, and of an id's texts the smallest is
    learnt from.  Repeated rows are graded each for itself.  kept: P(grade >= AT_LEAST) >= SELECT.  A null
    or empty text has no words and zero shares.  Without ratings nothing is
    learnt and every probability is 0.5.  Extra columns are ignored.
    """
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    model = train(docs, labels, grade)
    out = texts(docs).mapInArrow(_scorer(model), "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= SELECT)
