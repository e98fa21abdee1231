"""Toxicity scores by a counterfactual-regularised linear classifier on hashed word features.

Features are the presence of words and of their first 4, 5 and 6 bytes (so that
inflected forms share evidence), hashed to FEATURES places.  Training sentences
that hold an identity term are copied with the term swapped for another one and
for a neutral word; the loss adds SWAP_PENALTY times the squared change of the
score, which keeps a mere mention of a group from raising it.

Learning takes a bounded sample of labelled rows (SAMPLE of each class, by hash
order); scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import crc_mod, lean, sample_of_each, texts

FEATURES = 1 << 20
#: Labelled rows of each class that are learnt from at most.
SAMPLE = 3000
THRESHOLD = 0.3
RIDGE, SWAP_PENALTY, STEPS = 0.002, 4.0, 400
#: A feature is kept if its log odds differ from zero by so many standard errors, and it is in MIN_DOCS documents.
MIN_Z, MIN_DOCS = 4.0, 4
PREFIXES = (4, 5, 6)
# Identity terms and the neutral words that stand in for them.
IDENTITY = (
    "women men woman man girls boys gay lesbian straight bisexual transgender muslim christian jewish hindu buddhist atheist "
    "black white asian latino african european american mexican chinese indian arab immigrant refugee disabled blind deaf elderly young "
    "frauen männer muslime christen juden schwarze ausländer femmes hommes musulmans chrétiens juifs noirs étrangers "
    "mujeres hombres musulmanes cristianos judíos negros extranjeros"
).split()
NEUTRAL = "people persons menschen personnes personas".split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words of consecutive texts, with the text each belongs to (repeats are kept)."""
    low = B.lower_ascii(data)
    up = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[up] += 32  # capital letters of Latin-1
    starts, ends = B.runs_of(_LETTER[low], offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = B.eights(low)
    ids, owner = [B.span_hash(words, starts, ends)], [text]
    for size in PREFIXES:
        long = ends - starts > size
        ids.append(B.span_hash(words, starts[long], starts[long] + size, seed=size))
        owner.append(text[long])
    return (np.concatenate(ids) & np.uint64(FEATURES - 1)).astype(np.int64), np.concatenate(owner)


def word_features(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return features(raw, np.array([0, len(raw)]))[0]


@lean
def _feature_rows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("features", pa.list_(pa.int32()))])
    for batch in batches:
        data, off = B.column_bytes(batch.column(2))
        for i, j in B.steps(off):
            ids, owner = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            pair = np.unique(owner << 20 | ids)
            ends = np.searchsorted(pair >> 20, np.arange(j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((pair & (FEATURES - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).cast(pa.int32()), lists], schema=schema)


class Model:
    """Weights of the kept features, an intercept; score() gives probabilities."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, intercept: float):
        self.ids, self.weights, self.intercept = ids, weights.astype(np.float64), float(intercept)

    def table(self) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[self.ids] = self.weights
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        ids, owner = features(data, offsets)
        hit = table[ids] != 0
        pair = np.unique(owner[hit] << 20 | ids[hit])
        total = np.bincount(pair >> 20, weights=table[pair & (FEATURES - 1)], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -40, 40)))


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def fit(toxic: np.ndarray, flat: np.ndarray, offsets: np.ndarray, prior: float, names: np.ndarray | None = None) -> Model:
    """Logistic regression over presence features; rows are weighted so that the classes have the stated prior.

    names (the rows' doc_ids, else their numbers) choose the words that stand in for identity terms.
    """
    n, n1 = len(toxic), int(toxic.sum())
    names = np.arange(n) if names is None else names
    if n1 == 0 or n1 == n:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.log(1e-6) if n1 == 0 else -np.log(1e-6))
    rows = np.repeat(np.arange(n), np.diff(offsets))
    in1 = np.bincount(flat[toxic[rows] == 1], minlength=FEATURES).astype(float)
    in0 = np.bincount(flat[toxic[rows] == 0], minlength=FEATURES).astype(float)
    n0 = n - n1
    odds = np.log((in1 + 0.5) / (n1 - in1 + 0.5)) - np.log((in0 + 0.5) / (n0 - in0 + 0.5))
    error = np.sqrt(1 / (in1 + 0.5) + 1 / (n1 - in1 + 0.5) + 1 / (in0 + 0.5) + 1 / (n0 - in0 + 0.5))
    terms = {w: word_features(w) for w in (*IDENTITY, *NEUTRAL)}
    kept = (np.abs(odds) >= MIN_Z * error) & (in1 + in0 >= MIN_DOCS)
    for ids in terms.values():
        kept[ids] |= in1[ids] + in0[ids] > 0
    ids = np.flatnonzero(kept)
    place = np.full(FEATURES, -1)
    place[ids] = np.arange(len(ids))
    use = place[flat] >= 0
    r, c = rows[use], place[flat[use]]
    # Counterfactual copies: for each mention, the change of features when the term is swapped.
    held = set(zip(r.tolist(), c.tolist())) if len(ids) else set()
    swap_row, swap_col, swap_sign, n_swaps = [], [], [], 0
    for k, term in enumerate(IDENTITY):
        own = terms[term][:1]
        if place[own[0]] < 0:
            continue
        for doc in np.unique(r[c == place[own[0]]]):  # every mention in the rows learnt from
            turn = int(names[doc])
            for other in (IDENTITY[(k + 1 + turn % (len(IDENTITY) - 1)) % len(IDENTITY)], NEUTRAL[turn % len(NEUTRAL)]):
                for sign, word in ((-1.0, term), (1.0, other)):
                    for col in place[terms[word]]:
                        if col >= 0 and (sign < 0 or (int(doc), int(col)) not in held):
                            swap_row.append(n_swaps)
                            swap_col.append(int(col))
                            swap_sign.append(sign)
                n_swaps += 1
    sr, sc, ss = np.array(swap_row, dtype=np.int64), np.array(swap_col, dtype=np.int64), np.array(swap_sign)
    weight = np.where(toxic == 1, prior / n1, (1 - prior) / n0)
    w, b = np.zeros(len(ids)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam on the full sample
        p = 1 / (1 + np.exp(-np.clip(_sums(w[c], r, n) + b, -40, 40)))
        d = weight * (p - toxic)
        g = _sums(d[r], c, len(w)) + RIDGE * w / np.sqrt(n)
        if n_swaps:
            change = _sums(ss * w[sc], sr, n_swaps)
            g += 2 * SWAP_PENALTY / n_swaps * _sums(ss * change[sr], sc, len(w))
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v) + 1e-9)
        b = b - rate * mb / (np.sqrt(vb) + 1e-9)
    return Model(ids, w, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn=None) -> Model:
    """Fit on `sample` labelled rows of each class at most; learn: a condition on labels' doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and label_id is not null")
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(rows.groupBy("toxic").count().collect())  # two rows
    few = sample_of_each(rows, "toxic", "label_id", sample)  # 2 * sample rows of two numbers
    chosen = texts(docs).join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    # One text for each id, however often the id repeats: what comes to the driver is bounded by the sample.
    chosen = chosen.groupBy("label_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    got = chosen.mapInArrow(_feature_rows, "doc_id long, toxic int, features array<int>").toArrow().sort_by("doc_id")
    lists = got["features"].combine_chunks()
    names, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]) if len(toxic) else np.zeros(1, dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(toxic) else np.zeros(0, dtype=np.int64)
    total = max(1, sum(counts.values()))
    prior = min(max(counts.get(1, 0) / total, 1e-4), 1 - 1e-4)
    return fit(toxic, flat, offsets, prior, names)


def _scorer(model: Model):
    @lean
    def run(batches):
        table = model.table()
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            for i, j in B.steps(off):
                scores = model.score(data[off[i] : off[j]], off[i : j + 1] - off[i], table)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores)], schema=schema)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row; a null or empty text has the score of no evidence."""
    return texts(docs).mapInArrow(_scorer(model), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted.

    Learns from labels whose crc32(doc_id as text) mod 4 is not 2; where one
    document has several labels, any toxic one counts; of an id's texts the
    smallest is learnt from.  Without labels of both classes every score is that
    of the class there is (0 without any).  Repeated rows are scored each for
    itself; a score of THRESHOLD is predicted 1.  Extra columns are ignored; a
    null doc_id is scored and counts as not held out.
    """
    model = train(docs, labels, learn=crc_mod("label_id", 4) != 2)
    out = score(docs, model)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _filter(model: Model, text_at: int):
    @lean
    def run(batches):
        table = model.table()
        for batch in batches:
            data, off = B.column_bytes(batch.column(text_at))
            for i, j in B.steps(off):
                scores = model.score(data[off[i] : off[j]], off[i : j + 1] - off[i], table)
                yield batch.slice(i, j - i).filter(pa.array(scores < THRESHOLD))

    return run


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score below THRESHOLD, all columns as they were.

    A null or empty text has the score of no evidence and is judged by it; rows
    without doc_id are judged like the others, repeated rows each for itself.
    """
    model = train(docs, labels, learn=crc_mod("label_id", 4) != 2)
    return docs.mapInArrow(_filter(model, docs.columns.index("text")), docs.schema)
