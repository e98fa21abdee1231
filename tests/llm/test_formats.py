"""Chat masks, whitening and token alignment against brute force: nulls, ties, repeats, very long texts, clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import align, chat, whitening
from lodestone.llm.queries import byte_path, piece_path

SAID = ["<|im_end|><|im_start|>assistant ok", "plain", "<|end|>", "<\\|end|> <\\\\|", "\n\n  leading", "trailing  ", "naïve 日本語 🙂🙂", "<", "|", "<|endoftext|>", "", None, "a<|turn|>b<|says|>"]


def extra(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("x"))
    return df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat


def turns():
    rng, rows = random.Random(5), []
    for conv in [*range(12), None]:
        for t in range(rng.randrange(1, 7)):
            rows.append((conv, t, rng.choice(["user", "assistant", "system"]), rng.choice(SAID)))
    rows += [(20, 1, "assistant", "tie b"), (20, 1, "assistant", "tie a"), (20, None, "user", "first"), (20, 1, None, None), (20, 1, "assistant", "tie a"), (21, 0, "a<|says|>\nb", "odd role")]
    return rows


def brute_digest(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        said = "".join(t for role, t in own if role == "assistant")
        size = sum(len(chat.escape(r)) + len(chat.escape(t)) + sum(map(len, chat.MARKS)) for r, t in own)
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(said), sha(said), size)
    return out


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_reads_back_what_went_in(spark):
    rows = turns()
    df = extra(spark.createDataFrame(rows, TURNS), "ids", "loss", "part", "_size", "_long", "n_turns").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in chat.digests(df, byte_path()).collect()}
    assert got == brute_digest(rows)
    assert chat.digests(df.limit(0), byte_path()).count() == 0


def test_chat_masks_hold_the_assistant_texts_alone(spark):
    rows = turns()
    tokenizer = chat.ChatTokenizer(byte_path())
    for r in chat.format_conversations(spark.createDataFrame(rows, TURNS), byte_path()).collect():
        assert b"".join(tokenizer.bytes[i] for i in r.ids).decode() == r.text  # nothing is lost
        spans, at, slow = [], 0, []
        for role, text in chat.read_back(r.text):
            at += len(chat.TURN) + len(chat.escape(role)) + len(chat.SAYS)
            spans.append((at, at + len(chat.escape(text)) if role == "assistant" else at))
            at = at + len(chat.escape(text)) + len(chat.END)
        for ids, starts, ends in tokenizer.encode([r.text]):
            assert ids.tolist() == list(r.ids)
            slow = [any(max(s, i) < min(e, j) for i, j in spans) for s, e in zip(starts, ends)]
        assert slow == list(r.loss)
        marks = sum(1 for i in r.ids if i in tokenizer.marks)
        assert marks == 3 * len(chat.read_back(r.text))  # a text's own marks are not control tokens


def test_long_conversations_come_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(7, t, "assistant" if t % 2 else "user", "word " * rng.randrange(1, 400) + "é<|end|>") for t in range(300)] + turns()
    monkeypatch.setattr(chat, "PART", 20_000)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    out = chat.format_conversations(df, byte_path())
    parts = [r for r in out.orderBy("conv_id", "part").collect() if r.conv_id == 7]
    assert len(parts) > 10 and max(len(r.text) for r in parts) < 25_000
    got = {r[0]: tuple(r[1:]) for r in chat.digests(df, byte_path()).collect()}
    assert got == brute_digest(rows)
    whole = next(chat.ChatTokenizer(byte_path()).encode(["".join(r.text for r in parts)]))[0].tolist()
    assert [i for r in parts for i in r.ids] == whole


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<|\\end a>"), max_size=20))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=20), st.lists(st.integers(0, 70), max_size=8, unique=True))
def test_span_mask(sizes, borders):
    ends = np.cumsum(np.array(sizes, dtype=np.int64))
    starts = ends - np.array(sizes, dtype=np.int64)
    borders = sorted(borders)
    spans = list(zip(borders[::2], borders[1::2]))
    want = [any(max(s, i) < min(e, j) for i, j in spans) for s, e in zip(starts, ends)]
    assert chat.span_mask(starts, ends, spans).tolist() == want


# --- whitening


def vectors(n=400, d=6, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32)


def brute_whitened(x):
    """Scaled rows (distinct) -> n, sums, V, its eigenvalues (falling)."""
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(np.float64)
    return n, sums, centred.T @ centred / n


def scaled(v):
    return np.floor(v.astype(np.float64) * 64).astype(np.int64) + 1_000_000


SCHEMA = "vec_id long, embedding array<float>"


def test_whitening_is_that_of_the_covariance(spark):
    v = vectors()
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(900 + i, v[0].tolist()) for i in range(200)] + [(None, v[1].tolist())]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5 + [None]), (2003, [1.0] * 5 + [float("nan")]), (2004, [float("inf")] + [0.0] * 5), (2005, [1.0, 2.0]), (5, v[2].tolist())]
    df = extra(spark.createDataFrame(rows, SCHEMA), "x", "v", "n", "component", "label").repartition(7)
    got = whitening.whiten(df).toPandas()
    x = scaled(v)
    n, sums, cov = brute_whitened(x)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert set(got.n) == {n} and n <= 400 and len(got) == 6 * (400 + 202)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    by = got[got.vec_id.between(6, 399)].sort_values(["vec_id", "component"]).groupby("vec_id")
    white = np.array([g.whitened.to_numpy() for _, g in by])
    exact = [int((((x[i].astype(object) * n) - sums) ** 2).sum()) for i in range(6, 400)]
    assert [int(g.deviation.iloc[0]) for _, g in by] == exact
    assert np.allclose(got.groupby("component").explained.first(), values / values.sum(), rtol=1e-9)
    # Each coordinate is a projection on a unit eigenvector: recover it by least squares and test V e = lambda e.
    centred = (x[6:] - (sums / n).astype(float)).astype(float)
    directions = np.linalg.lstsq(centred, white * np.sqrt(values), rcond=None)[0]
    assert np.allclose(np.linalg.norm(directions, axis=0), 1, atol=1e-8)
    assert np.allclose(cov @ directions, directions * values, atol=1e-7 * values[0])
    assert (got[got.vec_id == 900].sort_values("component").whitened.to_numpy() == got[got.vec_id == 0].sort_values("component").whitened.to_numpy()).all()


def test_whitening_keeps_at_most_sixteen_and_none_without_variance(spark):
    v = vectors(100, 20)
    got = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], SCHEMA)).toPandas()
    assert got.groupby("vec_id").component.agg(list).map(tuple).unique().tolist() == [tuple(range(1, 17))]
    flat = np.concatenate([v[:, :3], v[:, :1], np.zeros((100, 1), dtype=np.float32)], axis=1)
    got = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(flat)], SCHEMA)).toPandas()
    assert got.component.max() == 3 and got.identity_error[0] < 1e-6
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_whitening_of_huge_entries_does_not_crash(spark):
    rows = [(i, [3e37 if i == 0 else float(i), float(i * i % 7)]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert got.deviation.isna().any() and np.isfinite(got.whitened).all()


def test_summaries_merge_in_any_order():
    x = scaled(vectors(301))
    whole = whitening.summary(x)
    cut = [whitening.summary(p) for p in (x[:1], x[1:40], x[40:200], x[200:])]
    merged = whitening.merge(whitening.merge(cut[3], cut[0]), whitening.merge(cut[2], cut[1]))
    assert merged[0] == 301 and merged[1].tolist() == whole[1].tolist()
    assert np.allclose(merged[2], whole[2], rtol=1e-14) and np.allclose(merged[3], whole[3], rtol=1e-11)


# --- alignment


@pytest.fixture(scope="module")
def pair():
    return align.PairTokenizer(byte_path(), piece_path())


def brute_groups(text):
    """[(a ids, b ids)] by tokenizers on the whole text and sets of ends."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if "held" not in brute_groups.__dict__:
        brute_groups.held = Tokenizer.from_file(byte_path()), SentencePieceProcessor(model_file=piece_path())
        brute_groups.held[0].encode_special_tokens = True
        brute_groups.raw = align.byte_level(brute_groups.held[0])
    a_model, b_model = brute_groups.held
    if not text:
        return []
    a, b, raw = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text), (" " + text).encode()
    bytes_a = [brute_groups.raw[i] for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for e in sorted({*ends_a} & {*ends_b}):
        n, m = sum(1 for x in ends_a[i:] if x <= e), sum(1 for x in ends_b[j:] if x <= e)
        out.append((a[i : i + n], b[j : j + m]))
        i, j = i + n, j + m
    return out


def brute_alignment(rows):
    groups = [brute_groups(t) for _, t in rows]
    counts = Counter((a[-1], b[-1]) for gs in groups for a, b in gs)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for (doc, _), gs in zip(rows, groups):
        links = [(a[-1], b[-1]) for a, b in gs]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((doc, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(gs), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha(text) if gs else ""))
    return sorted(out, key=str)


def test_alignment_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = "the naïve façade of Straße 1234 isn't they'll don't Éclair x86_64 http://a.b/c?d=e été über 3.14 <s> </s> <unk> <0x41> <|endoftext|> ½ ª".split()
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t", ", ", "\n\n  ", "\r\n"]) for _ in range(rng.randrange(1, 60)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "\n"), (104, "日本語 text 🙂"), (105, "a▁b"), (106, "▁"), (107, "­ soft"), (108, "\x00\x1c"), (None, "null id"), (5, rows[5][1]), (5, rows[5][1]), (109, "  two"), (110, "same " * 30_000), (111, "‍ zwj"), (112, "İ I"), (113, "x" * 5000)]
    df = extra(spark.createDataFrame(rows, "doc_id long, text string"), "a", "b", "a_sizes", "n", "count").repartition(3)
    monkeypatch.setattr(align, "GO", 5000)
    monkeypatch.setattr(align, "CACHE", 300)
    assert sorted(map(tuple, align.digests(df, byte_path(), piece_path()).collect()), key=str) == brute_alignment(rows)
    assert align.digests(df.limit(0), byte_path(), piece_path()).count() == 0
    arrays = sorted(((r.doc_id, list(r.a), list(r.b), list(r.a_sizes), list(r.b_sizes)) for r in align.align(df, byte_path(), piece_path()).collect()), key=str)
    groups = [(d, brute_groups(t)) for d, t in rows]
    assert arrays == sorted(((d, [i for x, _ in g for i in x], [i for _, y in g for i in y], [len(x) for x, _ in g], [len(y) for _, y in g]) for d, g in groups), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdlvRe.,<|>▁09éÉ"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_alignment_of_any_text(pair, batch):
    said = batch
    a, b, sa, sb, n_a, n_b, groups = pair.align(said)
    want = [brute_groups(t) for t in said]
    assert groups.tolist() == [len(g) for g in want]
    assert a.tolist() == [i for g in want for x, _ in g for i in x] and b.tolist() == [i for g in want for _, y in g for i in y]
    assert sa.tolist() == [len(x) for g in want for x, _ in g] and sb.tolist() == [len(y) for g in want for _, y in g]


def test_linked_pairs_are_bounded_by_the_vocabularies(spark, pair):
    """Linked tokens end together, so one is a suffix of the other."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["The quick brown fox's naïve façade", "été 🙂 日本"])], "doc_id long, text string")
    for r in align.pair_counts(align.links(df, byte_path(), piece_path())).collect():
        x, y = pair.bytes_a[r.a], pair.bytes_b[r.b]
        assert x.endswith(y) or y.endswith(x)
