"""Removal of repeated byte strings, decided on suffix arrays built by Lyndon grouping.

Every LENGTH-byte string that starts anywhere else too is removed.  To bring
equal strings together without one suffix array over everything:

1. Each string of LENGTH bytes has an anchor, its smallest GRAM-byte hash (the
   rightmost, if tied), so equal strings have it at the same place.  Strings
   that follow each other with one anchor, and lie in one of two blocks of
   places, are a run and share a core of bytes; its hash is their key.
2. Runs meet by key.  A key that occurs once holds nothing repeated.  Runs
   equal as a whole (by 128 bits of hashes of all their bytes, besides the key)
   are repeated as a whole.  What is left, different runs with one core, is
   decided on suffix arrays of the runs' bytes, in which equal cores are one symbol.
3. The suffix array is linear grouping construction: suffixes are grouped by
   their Lyndon prefix, groups are taken in descending order, and each sends its
   members' previous-smaller positions into finer groups; then the order within
   all groups is emitted in one ascending pass, without recursion or renaming.

So that no group grows with the input, the runs of a key with more than
SPLIT_RUNS different ones are cut into their single strings, each a run with a
core of its own: equal strings are then runs equal as a whole.  Runs of a batch
of texts are put together before they are shuffled, counts are partial
aggregations, and they come back by joins, which Spark splits where a key is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import discard, lean, settle, texts

LENGTH, GRAM = 200, 32
_PLACES = LENGTH - GRAM + 1
_BLOCK = (_PLACES + 1) // 2
#: Different runs of one key that meet in one suffix array at most; more are cut into single strings.
SPLIT_RUNS = 1000
#: Bytes of runs of different keys that share one suffix array, about: its lists stay in the processor cache.
BATCH_BYTES = 1 << 13
#: Bytes of runs that one task decides, about.
TASK_BYTES = 1 << 20
_LOW = np.uint64((1 << 30) - 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers, by Lyndon grouping; the end counts as smaller than all symbols."""
    # A smallest symbol before the text ends every walk to the left; one after it is the end.
    text = np.concatenate([[-1], np.asarray(symbols, dtype=np.int64), [0]])
    n = len(text)
    by_symbol = np.argsort(text, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[by_symbol] = np.arange(n)
    first = np.searchsorted(text[by_symbol], text, side="left")
    sizes = np.bincount(first, minlength=n)
    sa, at, group, size = by_symbol.tolist(), place.tolist(), first.tolist(), sizes.tolist()
    smaller = [0] * n

    # Groups in descending order; all above `end` are final.
    end = n
    while end > 1:
        start = group[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            j = i - 1
            while group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            g = group[j]
            s = size[g] - 1
            if s:
                last, here = g + s, at[j]
                other = sa[last]
                sa[here] = other
                sa[last] = j
                at[other] = here
                at[j] = group[j] = last
                size[g] = s
                size[last] = 1
        else:
            times: dict[int, int] = {}
            for i in sorted(sa[start:end]):
                j = i - 1
                while group[j] >= start:
                    j = smaller[j]
                smaller[i] = j
                times[j] = times.get(j, 0) + 1
            parts: dict[int, list[tuple[int, int]]] = {}
            for j, k in times.items():
                parts.setdefault(group[j], []).append((k, j))
            for g, moved in parts.items():  # those that hold the group's word more often sort higher
                moved.sort(reverse=True)
                stop = g + size[g]
                last, before, top = stop, 0, stop
                for k, j in moved:
                    if k != before:
                        if last < top:
                            size[last] = top - last
                            for q in range(last, top):
                                group[sa[q]] = last
                        before, top = k, last
                    last -= 1
                    here, other = at[j], sa[last]
                    sa[here], sa[last], at[other], at[j] = other, j, here, last
                left = last - g
                if left:
                    size[g] = left
                    size[last] = top - last
                    for q in range(last, top):
                        group[sa[q]] = last
                else:
                    size[g] = top - g
        end = start

    # Emit: a suffix, once in place, puts those in place whose next smaller suffix it is.
    out, slot, placed = [0] * n, list(range(n)), bytearray(n)
    out[1] = n - 1
    placed[0] = placed[n - 1] = 1
    for k in range(1, n):
        j = out[k] - 1
        while not placed[j]:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            placed[j] = 1
            j = smaller[j]
    return np.array(out[2:], dtype=np.int64) - 1


def repeated_strings(runs: list[bytes], cores: list[tuple[int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each run, which of its `length`-byte strings occur at another place of the runs too.

    cores: start and size of the bytes that all strings of a run share.  A core
    is one symbol in the suffix array, the same for equal bytes alone, so the
    arrays hold little more than what runs differ in.
    """
    names: dict[bytes, int] = {}
    parts = []
    for run, (start, size) in zip(runs, cores):
        symbols = np.frombuffer(run, dtype=np.uint8).astype(np.int64) + 2
        core = names.setdefault(run[start : start + size], 258 + len(names))
        parts += [symbols[:start], [core], symbols[start + size :], [1]]
    joined = np.concatenate(parts)
    held = np.array([size for _, size in cores])
    sizes = np.array([len(r) for r in runs]) - held + 1
    width = length - held + 1  # symbols of a string
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    sa = suffix_array(joined)
    run = np.searchsorted(at, sa, side="right") - 1
    whole = sa + width[run] <= at[run] + sizes[run]
    starts, width_of = sa[whole], width[run[whole]]
    mark = np.zeros(len(joined), dtype=bool)
    if len(starts) > 1:
        # Neighbours that differ in width or in their first or last symbol need no closer look.
        head, tail = joined[starts], joined[starts + width_of - 1]
        same = np.flatnonzero((head[1:] == head[:-1]) & (tail[1:] == tail[:-1]) & (width_of[1:] == width_of[:-1]))
        column = np.arange(width.max())
        for i in range(0, len(same), 4096):
            k = same[i : i + 4096]
            inside = column < width_of[k][:, None]
            left, right = (joined[np.minimum(starts[j][:, None] + column, len(joined) - 1)] for j in (k, k + 1))
            equal = ((left == right) | ~inside).all(axis=1)
            mark[starts[k[equal]]] = mark[starts[k[equal] + 1]] = True
    return [mark[at[i] : at[i] + max(0, sizes[i] - width[i] + 1)] for i in range(len(runs))]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray):
    """(text, first string's start in the text, strings, core, key, two hashes of the run's bytes) of all runs.

    core: the start of the shared bytes in the run, times 256, plus their number.
    """
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return (empty,) * 7
    words = B.eights(data)
    n = len(data) - GRAM + 1
    grams = words[:n] * _PLACE[0]  # anchors only bring strings together: a plain hash will do
    for k in range(1, GRAM // 8):
        grams += words[8 * k : 8 * k + n] * _PLACE[k]
    grams = (B.mix64(grams) & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    anchor = (_LOW - (_sliding_min(grams, _PLACES) & _LOW)).astype(np.int64)
    strings = np.maximum(np.diff(offsets) - LENGTH + 1, 0)  # of each text
    text = np.repeat(np.arange(len(strings)), strings)
    p = np.arange(len(text)) + np.repeat(offsets[:-1] - (np.cumsum(strings) - strings), strings)
    anchor = anchor[p]
    if not len(p):
        return (empty,) * 7
    block = (p - anchor + _PLACES - 1) // _BLOCK
    new = np.ones(len(p), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(p)))
    start, text, anchor, block = p[at], text[at], anchor[at], block[at]
    low = anchor - _PLACES + 1 + block * _BLOCK  # the block's first place; its last one is the core's start
    last = np.minimum(low + _BLOCK - 1, anchor)
    key = B.mix64(_span(words, last, low + LENGTH, 0)[0] + block.astype(np.uint64))
    place = (start - anchor).astype(np.uint64)
    whole = [B.mix64(h + place).view(np.int64) for h in _span(words, start, start + count + LENGTH - 1, 1, 2)]
    return text, start - offsets[text], count, (last - start) * 256 + low + LENGTH - last, key.view(np.int64), *whole


#: Weights of the eight-byte words of a gram.
_PLACE = B.mix64(np.arange(1, GRAM // 8 + 1, dtype=np.uint64)) | np.uint64(1)


def _span(words: np.ndarray, start: np.ndarray, end: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """For each seed, hashes of spans of at least eight bytes: eight bytes at a time into a mixed state, the last eight from the end."""
    size = (end - start).astype(np.uint64)
    states = [B.mix64(size + np.uint64(seed << 32)) for seed in seeds]
    steps = (end - start + 7) // 8  # the last one may overlap the one before
    least = int(steps.min(initial=1 << 62)) - 1 if len(steps) else 0
    for k in range(least):
        word = words[start + 8 * k]
        states = [B.mix64(h ^ word) for h in states]
    live, k = np.arange(len(start)), least
    while len(live):
        word = words[np.minimum(start[live] + 8 * k, end[live] - 8)]
        for h in states:
            h[live] = B.mix64(h[live] ^ word)
        k += 1
        live = live[steps[live] > k]
    return states


_RUN = pa.schema([("texts", pa.list_(pa.struct([("doc", pa.int64()), ("rid", pa.int64()), ("starts", pa.list_(pa.int32()))]))), ("places", pa.int32()), ("n", pa.int32()), ("core", pa.int32()), ("key", pa.int64()), ("run", pa.int64()), ("twin", pa.int64())])
_RUN_DDL = "texts array<struct<doc: long, rid: long, starts: array<int>>>, places int, n int, core int, key long, run long, twin long"


@lean
def _runs_task(batches):
    """One row for each different run of some texts, with all its places: what repeats near itself is one row."""
    for batch in batches:
        doc, rid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, off = B.column_bytes(batch.column(2))
        for i, j in B.steps(off):
            found = runs(data[off[i] : off[j]], off[i : j + 1] - off[i])
            text, *_, key, run, twin = found
            order = np.lexsort((text, twin, run, key))
            text, start, count, core, key, run, twin = (x[order] for x in found)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1]) | (twin[1:] != twin[:-1])
            first = np.flatnonzero(new)
            other = new.copy()
            other[1:] |= text[1:] != text[:-1]
            inner = np.flatnonzero(other)
            starts = pa.ListArray.from_arrays(pa.array(np.append(inner, len(key)).astype(np.int32)), pa.array(start.astype(np.int32)))
            cells = pa.StructArray.from_arrays([pa.array(doc[i:j][text[inner]]), pa.array(rid[i:j][text[inner]]), starts], fields=list(_RUN.field(0).type.value_type))
            bounds = np.append(np.searchsorted(inner, first), len(inner)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), cells)
            places = np.diff(np.append(first, len(key))).astype(np.int32)
            columns = [lists, pa.array(places), *(pa.array(x[first].astype(np.int32)) for x in (count, core)), *(pa.array(x[first]) for x in (key, run, twin))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _RUN)], schema=_RUN)


_CUT = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("twin", pa.int64()), ("core", pa.int32()), ("bytes", pa.binary())])
_CUT_DDL = "key long, run long, twin long, core int, bytes binary"


def _cut(batches):
    """(text, parts) -> (key, run, twin, core, bytes)."""
    for batch in batches:
        data, off = B.column_bytes(batch.column(0))
        for k, parts in enumerate(batch.column(1).to_pylist()):
            own = data[off[k] : off[k + 1]]
            cells = [(p["key"], p["run"], p["twin"], p["core"], own[p["start"] : p["start"] + p["n"] + LENGTH - 1].tobytes()) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells), _CUT)], schema=_CUT)


_DECIDED = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("twin", pa.int64()), ("spans", pa.list_(pa.int32()))])


def _spans(mark: np.ndarray) -> list[int]:
    """Borders of the true runs: start, end, start, end, ..."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8))).tolist()


@lean
def _decide(batches):
    """Rows in the order of their keys -> the repeated strings of each run; all runs of a key share a suffix array."""
    names: list[tuple] = []
    held: list[bytes] = []
    cores: list[tuple[int, int]] = []
    size = 0

    def out():
        spans = [_spans(m) for m in repeated_strings(held, cores)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*names)), pa.array(spans, pa.list_(pa.int32()))], schema=_DECIDED)

    for batch in batches:
        for *name, core, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if names and name[0] != names[-1][0] and size > BATCH_BYTES:
                yield out()
                names, held, cores, size = [], [], [], 0
            names.append(name)
            held.append(raw)
            cores.append(divmod(core, 256))
            size += len(raw) - core % 256
    if names:
        yield out()


def _singles(batches):
    """(key, run, twin, bytes) -> a row for each string: the run it is in, its place there and two hashes of its bytes."""
    schema = pa.schema([*_CUT][:3] + [pa.field("place", pa.int32()), pa.field("hash", pa.int64()), pa.field("other", pa.int64())])
    for batch in batches:
        for *name, _, raw in zip(*(c.to_pylist() for c in batch.columns)):
            data = np.frombuffer(raw, dtype=np.uint8)
            i = np.arange(len(data) - LENGTH + 1)
            hashes = [h.view(np.int64) for h in _span(B.eights(data), i, i + LENGTH, 3, 4)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(i), pa.int64()) for x in name), pa.array(i.astype(np.int32)), *map(pa.array, hashes)], schema=schema)


_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


@lean
def _remove(batches):
    """(doc_id, text, from, to): the strings that start in [from, to) of the sorted spans go."""
    for batch in batches:
        data, off = B.column_bytes(batch.column(1))
        lists = batch.column(2)
        has = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        first = np.cumsum(has) - has
        a, b = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        rows = []
        for k in range(batch.num_rows):
            own, spans = data[off[k] : off[k + 1]], 0
            gone, kept, last = 0, hashlib.sha256(), 0
            lo, hi = first[k], first[k] + has[k]
            if has[k]:
                starts, ends = a[lo:hi], np.minimum(np.maximum.accumulate(b[lo:hi]) + LENGTH - 1, len(own))  # starts ascend
                new = np.append(True, starts[1:] > ends[:-1])
                at = np.flatnonzero(new)
                for s, e in zip(starts[at].tolist(), ends[np.append(at[1:] - 1, len(starts) - 1)].tolist()):
                    kept.update(own[last:s].data)
                    gone, spans, last = gone + e - s, spans + 1, e
            kept.update(own[last:].data)
            rows.append((len(own), gone, spans, kept.hexdigest()))
        cells = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cells, list(_REMOVED)[1:]))], schema=_REMOVED)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are named by their doc_id and a hash of their text, together."""
    return texts(docs).select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("rid"))


_NAME = ["key", "run", "twin"]


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc, rid, spans): where strings start that occur elsewhere too, as half-open spans of byte places."""
    found = settle(docs.where(F.octet_length("text") >= LENGTH).select("doc", "rid", "text").mapInArrow(_runs_task, _RUN_DDL))
    keys = found.groupBy("key").agg(F.sum("places").alias("total")).where("total > 1").select("key")
    met = settle(found.join(keys.hint("merge"), "key"))
    discard(found)
    lead = F.min(F.struct(F.get("texts", F.lit(0))["doc"].alias("doc"), F.get("texts", F.lit(0))["rid"].alias("rid"), F.get(F.get("texts", F.lit(0))["starts"], F.lit(0)).alias("start")))
    by_run = settle(met.groupBy(*_NAME).agg(F.sum("places").alias("same"), F.first("n").alias("n"), F.first("core").alias("core"), lead.alias("lead")))
    # A key all of whose runs are repeated as they are has nothing left to decide.
    by_key = by_run.groupBy("key").agg(F.count(F.lit(1)).alias("n_runs"), F.min("same").alias("least")).where("n_runs > 1 and least = 1")
    status = settle(by_run.join(by_key.select("key", "n_runs").hint("merge"), "key"))

    whole = met.join(by_run.where("same > 1").select(*_NAME).hint("merge"), _NAME).select(F.explode("texts").alias("x"), "n")
    whole = whole.select("x.doc", "x.rid", F.explode("x.starts").alias("a"), "n").select("doc", "rid", "a", (F.col("a") + F.col("n")).alias("b"))

    part = F.struct(*_NAME, F.col("lead.start").alias("start"), "n", "core", "n_runs")
    parts = status.groupBy(F.col("lead.doc").alias("doc"), F.col("lead.rid").alias("rid")).agg(F.collect_list(part).alias("parts"))  # a text's own runs
    held = parts.join(docs.select("doc", "rid", "text").dropDuplicates(["doc", "rid"]), ["doc", "rid"])
    few = lambda hot: F.filter("parts", lambda p: (p["n_runs"] > SPLIT_RUNS) if hot else (p["n_runs"] <= SPLIT_RUNS))
    cut = settle(held.select("text", few(False).alias("parts")).where(F.size("parts") > 0).mapInArrow(_cut, _CUT_DDL))
    size = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    decided = cut.repartition(max(1, -(-size // TASK_BYTES)), "key").sortWithinPartitions("key").mapInArrow(_decide, "key long, run long, twin long, spans array<int>")
    pair = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("a"), F.get("spans", i + 1).alias("b")))
    decided = decided.where(F.size("spans") > 0).select(*_NAME, F.explode(pair).alias("x")).select(*_NAME, "x.a", "x.b")

    split = settle(held.select("text", few(True).alias("parts")).where(F.size("parts") > 0).mapInArrow(_cut, _CUT_DDL))
    if not split.isEmpty():
        single = settle(split.mapInArrow(_singles, "key long, run long, twin long, place int, hash long, other long"))
        twice = single.groupBy("hash", "other").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash", "other")
        decided = decided.union(single.join(twice.hint("merge"), ["hash", "other"]).select(*_NAME, F.col("place").alias("a"), (F.col("place") + 1).alias("b")))

    alone = status.where("same = 1").select(*_NAME, "lead")
    some = alone.join(decided, _NAME).select("lead.doc", "lead.rid", (F.col("lead.start") + F.col("a")).alias("a"), (F.col("lead.start") + F.col("b")).alias("b"))
    return whole.union(some).groupBy("doc", "rid").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))  # a text's own spans


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty.  Texts shorter than LENGTH bytes lose nothing;
    strings never cross documents; rows that repeat count as each other's
    copies, and so do equal texts of rows without doc_id.  Extra columns are
    ignored.  No rows give no rows.
    """
    docs = _keyed(docs)
    spans = settle(_repeated(docs)).select(F.col("doc").alias("_doc"), F.col("rid").alias("_rid"), "spans")
    rows = docs.join(spans, (docs.doc == spans._doc) & (docs.rid == spans._rid), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
