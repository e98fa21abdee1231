"""Language identification by a byte convolutional network, trained and applied with numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum over the window, and a softmax over those maxima
gives the window's language.  A document's windows cover its whole text; its
prediction is the language with the highest mean log probability, its score the
share of that language after normalising.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import crc_mod, lean, sample_of_each, texts

#: Bytes of a window, embedding size, filters of each width.
WINDOW, EMBED = 192, 6
WIDTHS = {2: 8, 3: 8, 5: 12}
WIDEST = max(WIDTHS)
FILTERS = sum(WIDTHS.values())
#: Learnt from at most so many documents of each language, by hash order, and of all their windows from so many of each
#: language, each text's in turn, and so many in all; with more languages than LANGUAGES, from the most frequent ones.
SAMPLE, SAMPLE_WINDOWS, SAMPLE_TOTAL, LANGUAGES = 400, 2400, 100_000, 2000
EPOCHS, BATCH, RATE = 8, 128, 0.004
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes that cover all texts, and the text of each; ends are filled with spaces.

    ASCII capitals are lowered.  A text has ceil(bytes / WINDOW) windows; neighbours do not overlap.
    """
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    out = np.full(int(count.sum()) * WINDOW, 32, dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) * WINDOW
    out[np.arange(len(data)) + np.repeat(first - offsets[:-1], size)] = B.lower_ascii(data)
    return out.reshape(-1, WINDOW), owner


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        # Filters of all widths lie in one matrix over WIDEST bytes; a narrower filter is zero beyond its width.
        self.mask = np.zeros((WIDEST * EMBED, FILTERS), dtype=np.float32)
        at = 0
        for width, n in WIDTHS.items():
            self.mask[: width * EMBED, at : at + n] = 1
            at += n
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS, max(1, len(languages)))).astype(np.float32)
        self.out_bias = np.zeros(max(1, len(languages)), dtype=np.float32)

    def _unfold(self, batch: np.ndarray) -> np.ndarray:
        steps = WINDOW - WIDEST + 1
        e = self.embed[batch].reshape(len(batch), WINDOW * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDEST * EMBED, axis=1)[:, ::EMBED]
        return np.ascontiguousarray(view).reshape(len(batch) * steps, WIDEST * EMBED)

    def log_probabilities(self, batch: np.ndarray) -> np.ndarray:
        """(n, languages), a few windows at a time so that the unfolded bytes stay in cache."""
        parts = []
        for i in range(0, len(batch), 32):
            x = batch[i : i + 32]
            h = (self._unfold(x) @ self.filters).reshape(len(x), -1, FILTERS).max(axis=1)
            parts.append(np.maximum(h + self.bias, 0))
        z = np.concatenate(parts) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the cross entropy; the maximum passes its gradient to the place it was taken from."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t, steps = 0, WINDOW - WIDEST + 1
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                xb, yb, n = x[pick], y[pick], len(pick)
                u = self._unfold(xb)
                a = (u @ self.filters).reshape(n, steps, FILTERS)
                where = a.argmax(axis=1)
                h = np.maximum(np.take_along_axis(a, where[:, None, :], axis=1)[:, 0] + self.bias, 0)
                z = h @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(n), yb] -= 1
                d /= n
                g = {"out": h.T @ d, "out_bias": d.sum(axis=0)}
                dh = (d @ self.out.T) * (h > 0)
                g["bias"] = dh.sum(axis=0)
                rows = u.reshape(n, steps, -1)[np.arange(n)[:, None], where]  # (n, FILTERS, WIDEST*EMBED)
                g["filters"] = np.einsum("nf,nfk->kf", dh, rows) * self.mask
                de = (dh[:, :, None] * self.filters.T[None]).reshape(n, FILTERS, WIDEST, EMBED)
                at = xb[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDEST)]
                ge = np.zeros_like(self.embed)
                np.add.at(ge, at.ravel(), de.reshape(-1, EMBED))
                g["embed"] = ge
                t += 1
                rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    setattr(self, k, (getattr(self, k) - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and share for each text; texts without bytes get number 0 and share 0."""
        n = len(offsets) - 1
        total = np.zeros((n, max(1, len(self.languages))))
        w, owner = windows(data, offsets)
        for i in range(0, len(w), 4096):
            np.add.at(total, owner[i : i + 4096], self.log_probabilities(w[i : i + 4096]))
        count = np.maximum(1, -(-np.diff(offsets) // WINDOW))
        z = np.exp(total / count[:, None])
        share = z / z.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, np.where(np.diff(offsets) > 0, share[np.arange(n), best], 0.0)


def _turns(limit: int):
    """(lang, text) -> (lang, turn, mark, window): the different windows of each whole text in order of a hash, `limit` at most."""

    @lean
    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("turn", pa.int64()), ("mark", pa.int64()), ("window", pa.binary())])
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                w, _ = windows(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                kept: list[tuple[int, bytes]] = []
                for k in range(0, len(w), 4096):
                    kept = sorted({*kept, *((zlib.crc32(x), x) for x in (row.tobytes() for row in w[k : k + 4096]))})[:limit]
                if kept:
                    marks, found = zip(*kept)
                    yield pa.RecordBatch.from_arrays([pa.array([langs[i]] * len(kept), pa.string()), pa.array(range(len(kept)), pa.int64()), pa.array(marks, pa.int64()), pa.array(found, pa.binary())], schema=schema)

    return run


def train(docs: DataFrame, learn=None, sample: int = SAMPLE) -> Network:
    """Train on a sample (see above) of at most `sample` documents of each value of lang; all values learnt are told apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("chosen"), F.col("lang").cast("string").alias("tongue")).where("tongue is not null and chosen is not null")
    if learn is not None:
        rows = rows.where(learn)
    most = rows.groupBy("tongue").count().orderBy(F.desc("count"), "tongue").limit(LANGUAGES).select("tongue")
    languages = sorted(r["tongue"] for r in most.collect())  # the network's outputs
    net = Network(languages)
    if len(languages) < 2:
        return net
    rows = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in languages], "tongue string")), "tongue")
    few = sample_of_each(rows.select("chosen", "tongue").distinct(), "tongue", "chosen", max(1, min(sample, SAMPLE_TOTAL // len(languages))))
    picked = texts(docs, F.col("lang").cast("string").alias("lang")).join(F.broadcast(few), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("tongue")))
    # One text for each id and language, however often the id repeats.
    picked = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    # Every text gives one window before any gives a second one: long texts do not crowd out short ones.
    n = max(1, min(SAMPLE_WINDOWS, SAMPLE_TOTAL // len(languages)))
    seen = picked.select("lang", "text").mapInArrow(_turns(n), "lang string, turn long, mark long, window binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "mark", "window"))
    got = seen.withColumn("place", place).where(F.col("place") <= n).select("lang", "window").toArrow()
    pairs = sorted(set(zip(got["lang"].to_pylist(), got["window"].to_pylist())))
    if pairs:
        number = {lang: k for k, lang in enumerate(languages)}
        x = np.frombuffer(b"".join(w for _, w in pairs), dtype=np.uint8).reshape(-1, WINDOW)
        net.train(x, np.array([number[lang] for lang, _ in pairs]))
    return net


def _apply(net: Network):
    @lean
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        names = np.array([*net.languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            for i, j in B.steps(off):
                if net.languages:
                    best, share = net.predict(data[off[i] : off[j]], off[i : j + 1] - off[i])
                else:
                    best, share = np.full(j - i, -1), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(share)], schema=schema)

    return run


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score for every row; `und` and 0 where the text is null or has no letter."""
    clean = texts(docs).withColumn("text", F.when(F.col("text").rlike("\\p{L}"), F.col("text")))
    out = clean.mapInArrow(_apply(net), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.when(F.col("score") > 0, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), "score")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score.

    Learns from rows with a lang whose crc32(doc_id as text) mod 3 is not 1.
    With one learnt language it is predicted with score 1, with none every row
    is `und`.  Of languages with one score the first by name is predicted.
    Repeated rows are judged each for itself.  Extra columns are ignored; a
    null doc_id counts as not held out.
    """
    net = train(docs, learn=crc_mod("chosen", 3) != 1)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return identify(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
