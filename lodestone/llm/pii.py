"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence.

Base kinds are found by pattern.  The method then estimates, over the whole
corpus, how much a term t tells about a protected entity e (a normalised base
match): with document frequencies, PMI(t, e) / IC(e), where IC(e) = -log p(e).
It is 1 where t occurs near e alone and 0 where t is independent of e.  Terms
near an entity (WINDOW words either side) whose share is at least DISCLOSURE,
in at least two different contexts, disclose it.  They are marked wherever they
stand, in all documents, as kind `term`; sanitise() generalises marked spans.

Terms are told apart by 64-bit hashes.  The disclosing ones go to the tasks as
an array of at most TERM_BLOCK hashes; more are taken in so many passes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import lean, settle, texts

KINDS = ("email", "ip", "card", "phone")
#: Words either side of an entity that can disclose it.
WINDOW = 8
#: PMI as a share of the entity's information from which a term discloses it.
DISCLOSURE = 0.95
#: Disclosing terms (8 bytes each) that one pass over the documents looks for.
TERM_BLOCK = 1_000_000
#: Different words that a task counts at a time, about, and rows that it holds as text.
COUNT_BLOCK, ROWS = 100_000, 250

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            done = hit.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def _ips(text: str):
    """Dotted digit runs, four parts at a time from the left: what the leftmost search of the pattern finds."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(int(p[-400:]) <= 255 and not p[:-400].strip("0") for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base matches, in order; ends are exclusive code points."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    out += [(s, 1, e) for s, e in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit hashes of words as they stand."""
    blob = [w.encode() for w in words]
    ends = np.cumsum(np.fromiter(map(len, blob), dtype=np.int64, count=len(blob)))
    data = np.frombuffer(b"".join(blob), dtype=np.uint8)
    return B.span_hash(B.eights(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends).view(np.int64)


def _entity(kind: int, value: str) -> int:
    plain = value.lower() if kind == 0 else value if kind == 1 else _DIGITS.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}\0{plain}".encode(), digest_size=8).digest(), "little", signed=True)


_NEAR = pa.schema([("term", pa.int64()), ("entity", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_ENTITY = pa.schema([("entity", pa.int64())])


def nearby(text: str, spans) -> list[list[tuple[int, int, str]]]:
    """For each base match the WINDOW words before and after it; words that touch a base match are left out."""
    words = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    touched = set()
    for start, _, end in spans:
        touched.update(range(bisect_right(ends, start), bisect_left(starts, end)))
    out = []
    for start, _, end in spans:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        around = [*range(max(0, before - WINDOW), before), *range(after, min(len(words), after + WINDOW))]
        out.append([words[k] for k in around if k not in touched])
    return out


def _pairs(text: str, spans) -> dict[tuple[int, int], tuple[int, int]]:
    """(term, entity) -> smallest and largest context hash, for one text."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for (start, kind, end), around in zip(spans, nearby(text, spans)):
        if not around:
            continue
        entity, keys = _entity(kind, text[start:end]), word_keys([w for _, _, w in around])
        context = int(B.mix64(keys.view(np.uint64) * B._PLACE[: len(keys)]).sum(dtype=np.uint64).view(np.int64))
        for term in keys.tolist():
            lo, hi = out.get((term, entity), (context, context))
            out[term, entity] = min(lo, context), max(hi, context)
    return out


def _slices(batches):
    """Batches of at most ROWS rows: texts are held twice, as Arrow and as str."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


@lean
def _find(batches):
    """Text -> (term, entity, lo, hi) for each pair that is near in it, and (null, entity, null, null) for each entity."""
    for batch in _slices(batches):
        rows: list[tuple] = []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text) if text else []
            if spans:
                rows += [(t, e, lo, hi) for (t, e), (lo, hi) in _pairs(text, spans).items()]
                rows += [(None, e, None, None) for e in {_entity(k, text[s:e]) for s, k, e in spans}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_NEAR)


@lean
def _frequencies(batches):
    """Document frequencies of all words, pre-aggregated in blocks; terms are told apart by 64-bit hashes."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])
    count: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(word_keys(list(count))), pa.array(list(count.values()), pa.int64())], schema=schema)

    for batch in _slices(batches):
        for text in batch.column(0).to_pylist():
            count.update({w.lower() for w in set(_WORD.findall(text or ""))})
        if len(count) > COUNT_BLOCK:
            yield out()
            count.clear()
    if count:
        yield out()


def disclosing(docs: DataFrame) -> DataFrame:
    """(term, entity) pairs whose share of the entity's information reaches DISCLOSURE, from all documents."""
    text = docs.select("text").where("text is not null")
    n = docs.count()
    found = settle(text.mapInArrow(_find, "term long, entity long, lo long, hi long"))
    joint = found.where("term is not null").groupBy("term", "entity").agg(F.count(F.lit(1)).alias("both"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_entity = found.where("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    by_term = text.mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df_t"))
    share = F.log(F.col("both") * n / (F.col("df_t") * F.col("df_e"))) / -F.log(F.col("df_e") / F.lit(float(max(n, 1))))
    pairs = joint.where("lo < hi").select("term", "entity", "both").join(by_entity.where(F.col("df_e") < n), "entity").join(by_term, "term")
    return pairs.where(share >= DISCLOSURE).select("term", "entity")


def term_spans(texts_: list[str | None], terms: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text (start, end) of all occurrences of disclosing terms; terms: their hashes, ascending."""
    if not len(terms):
        return [[] for _ in texts_]
    words = [set(_WORD.findall(t or "")) for t in texts_]
    every = list(set().union(*words))
    hit: set[str] = set()
    if every:
        keys = word_keys([w.lower() for w in every])
        place = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
        hit = {every[k] for k in np.flatnonzero(terms[place] == keys)}
    return [[] if hit.isdisjoint(ws) else [m.span() for m in _WORD.finditer(t) if m.group() in hit] for t, ws in zip(texts_, words)]


def all_spans(text: str | None, held) -> tuple[list, list]:
    """The base spans, and of the held spans of disclosing terms those that touch no base span."""
    if not text:
        return [], []
    base = base_spans(text)
    out, k, reach = [], 0, -1
    for start, end in sorted(held):
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            out.append((start, len(KINDS), end))
    return base, out


_HELD = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _with_terms(text_at: int, terms: np.ndarray, batches):
    """(batch, texts, term spans held in its last column or found now) for each slice of the batches."""
    for batch in _slices(batches):
        text = batch.column(text_at).to_pylist()
        held = [[(x["start"], x["end"]) for x in h or []] for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield batch, text, [a + b for a, b in zip(held, term_spans(text, terms))]


def _mark(text_at: int, terms: np.ndarray):
    """Adds the spans of terms to the last column."""

    def run(batches):
        for batch, _, spans in _with_terms(text_at, terms, batches):
            held = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _HELD)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], held], names=batch.schema.names)

    return lean(run)


def _before_last_pass(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """docs with a last column of term spans, and the terms that are still to be looked for."""
    terms = settle(disclosing(texts(docs)).select("term").distinct())
    n = max(1, -(-terms.count() // TERM_BLOCK))
    block = lambda b: np.sort(terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == b).toArrow()["term"].to_numpy())
    name = "_pii_terms"
    while name in docs.columns:
        name += "_"
    docs = docs.withColumn(name, F.array().cast("array<struct<start: int, end: int>>"))
    for b in range(n - 1):
        docs = settle(docs.mapInArrow(_mark(docs.columns.index("text"), block(b)), docs.schema))
    return docs, block(n - 1)


_REPORT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_term", pa.int64())])


def _report(terms: np.ndarray):
    names = (*KINDS, "term")

    def row(text, held):
        base, more = all_spans(text, held)
        counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
        said = joined((s, names[k], e) for s, k, e in base)
        every = joined((s, names[k], e) for s, k, e in sorted(base + more))
        return (*counts, hashlib.sha256(said.encode()).hexdigest(), every, len(more))

    def run(batches):
        for batch, text, spans in _with_terms(1, terms, batches):
            cells = [pa.array(c, f.type) for c, f in zip(zip(*map(row, text, spans)), list(_REPORT)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], schema=_REPORT)

    return lean(run)


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    A null text counts as empty: no spans.  Rows that repeat give rows that
    repeat; the corpus statistics count each such row's document.  A term at
    the threshold is marked; one that touches a base match is not.  Extra
    columns are ignored.  No rows give no rows.
    """
    rows, terms = _before_last_pass(texts(docs))
    ddl = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_term long"
    return rows.mapInArrow(_report(terms), ddl)


def _rewrite(text_at: int, terms: np.ndarray):
    marks = [f"[{k.upper()}]" for k in KINDS] + ["[TERM]"]

    def clean(text: str | None, held) -> str | None:
        if not text:
            return text
        base, more = all_spans(text, held)
        out, at = [], 0
        for start, kind, end in sorted(base + more):
            if start >= at:
                out += [text[at:start], marks[kind]]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch, text, spans in _with_terms(text_at, terms, batches):
            new = pa.array(list(map(clean, text, spans)), pa.string())
            columns = [new if k == text_at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return lean(run)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with marked spans replaced by their kind; all rows and columns stay, n_chars (if there) follows the text.

    A null or empty text stays as it is, and so do rows that repeat, each for
    itself.  No rows give no rows.
    """
    rows, terms = _before_last_pass(docs)
    out = rows.mapInArrow(_rewrite(docs.columns.index("text"), terms), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
