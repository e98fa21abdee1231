"""State that depends on its own past: patience and the adaptive rate, folded over a group's ordered rows.

Rows fall into ranges of (group, order), so one long group is worked on by all
tasks.  A first pass sums up what a range's rows of a group do to any state
before them; the summaries are run through in order, one lookup each, which
gives the state before every range; the second pass folds the rows.  Only
groups with a border inside take part in the first pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import range_count, ranges, wide_groups


def _fold(df: DataFrame, group: str, order: str, values: list[str], states: str, step: Callable[..., tuple], summary: Callable, resume: Callable) -> DataFrame:
    """df with the columns `states` (DDL) after each row: step(state before or None, *values) -> state.

    summary(*arrays) of the values of some rows in order, and
    resume(state before or None, summary) is the state after them.
    """
    names = [c.split()[0] for c in states.split(", ")]
    rows = df.select(group, order, *values)
    kinds = rows.dtypes
    schema = ", ".join(f"{c} {t}" for c, t in kinds) + f", {states}"
    key = [F.col(group), F.col(order)]
    n = range_count(df)
    cut = ranges(rows, key, n)
    dealt = rows.withColumn("_range", cut.of(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(key)])))
    carried = {}
    if cut.borders:
        wide = dealt.where(wide_groups(cut, F.col(group)))
        parts = wide.repartitionById(n, F.col("_range")).sortWithinPartitions("_range", group, order).mapInPandas(_summaries(group, values, summary), f"{group} {kinds[0][1]}, _range int, _summary binary")
        before = parts.repartition(group).sortWithinPartitions(group, "_range").mapInPandas(_carry(group, resume), f"{group} {kinds[0][1]}, _range int, _state binary")
        carried = {(r[0], r[1]): pickle.loads(r[2]) for r in before.collect()}  # a row for each border and one for each group that has any

    def run(parts):
        last, state = (), None
        for part in parts:
            out = []
            for key, at, *xs in zip(_keys(part[group]), part["_range"].tolist(), *(part[v].tolist() for v in values)):
                if (key, at) != last:
                    last, state = (key, at), carried.get((key, at))
                state = step(state, *xs)
                out.append(state)
            yield pd.concat([part.drop(columns="_range"), pd.DataFrame(out, columns=names, index=part.index)], axis=1)

    return dealt.repartitionById(n, F.col("_range")).sortWithinPartitions("_range", group, order).mapInPandas(run, schema)


def _keys(column: pd.Series) -> list:
    """Plain values; a null is None."""
    return [None if x is None or x != x else x for x in column.tolist()]


def _summaries(group: str, values: list[str], summary: Callable):
    """Sorted rows -> (group, _range, _summary): a row for each group of a range."""

    def run(parts):
        last, held = None, []

        def close():
            key, at = last
            return pd.DataFrame({group: [key], "_range": [at], "_summary": [pickle.dumps(summary(*(np.concatenate(c) for c in zip(*held))))]})

        for part in parts:
            keys, at = _keys(part[group]), part["_range"].tolist()
            arrays = [part[v].to_numpy() for v in values]
            starts = [i for i in range(len(keys)) if i == 0 or (keys[i], at[i]) != (keys[i - 1], at[i - 1])]
            for i, j in zip(starts, [*starts[1:], len(keys)]):
                if last is not None and last != (keys[i], at[i]):
                    yield close()
                    held = []
                last = keys[i], at[i]
                held.append([a[i:j] for a in arrays])
        if last is not None:
            yield close()

    return run


def _carry(group: str, resume: Callable):
    """Summaries by group and range -> (group, _range, _state): the state before each range but a group's first."""

    def run(parts):
        last, state = None, None
        for part in parts:
            out = []
            for key, at, blob in zip(_keys(part[group]), part["_range"].tolist(), part["_summary"]):
                if last is None or last != (key,):
                    last, state = (key,), None
                else:
                    out.append((key, at, pickle.dumps(state)))
                state = resume(state, pickle.loads(blob))
            yield pd.DataFrame(out, columns=[group, "_range", "_state"])

    return run


PATIENCE = "reference double, counter long, stagnated boolean"
RATE = "rate double, stagnant long, reason string"


def patience_step(tolerance: float, limit: int) -> Callable[..., tuple]:
    """The state of patience after a value, from the one before it (None at first)."""
    if not tolerance >= 0:
        raise ValueError("the tolerance must not be negative")

    def step(state, x):
        if state is None or x > state[0] + tolerance:
            return x, 0, limit <= 0
        counter = min(state[1] + 1, limit)
        return state[0], counter, counter >= limit

    return step


def rate_step(initial: float, low: float, high: float, step: float, threshold: float, reset: bool) -> Callable[..., tuple]:
    """The state of the adaptive rate after a generation's diversity and improvement, from the one before it."""
    start = min(max(initial, low), high)

    def up(rate):
        return high if step > high - rate else rate + step

    def then(state, d, better):
        poor = d <= threshold
        if state is None:
            return (up(start), 0, "low-diversity") if poor else (start, 0, "initial")
        rate, stagnant, _ = state
        if not better:
            return up(rate), stagnant + 1, "stagnation-low-diversity" if poor else "stagnation"
        if reset:
            return low, 0, "improvement-reset"
        return (up(rate), 0, "low-diversity") if poor else (rate, 0, "improvement-hold")

    return then


def patience(df: DataFrame, group: str, order: str, value: str, tolerance: float, limit: int) -> DataFrame:
    """Adds reference and counter after each row: only value > reference + tolerance moves the reference and
    zeroes the counter; otherwise it grows up to `limit`.  stagnated: the counter is at the limit."""
    step = patience_step(tolerance, limit)

    # A reference is never more than the tolerance below the best value so far, so only a strict record can move it:
    # of a range's rows, its own records are all that matter, and where each leads to is found from the last one back.
    def summary(xs):
        best = np.fmax.accumulate(np.concatenate([[-np.inf], xs[:-1]])) if len(xs) else xs
        places = np.flatnonzero(xs > best)
        if len(xs) and xs[0] == -np.inf:
            places = np.concatenate([[0], places])
        records = xs[places]
        onward = np.searchsorted(records, records + tolerance, side="right")
        last = np.arange(len(records))
        for i in range(len(records) - 1, -1, -1):
            if onward[i] < len(records):
                last[i] = last[max(onward[i], i + 1)]
        return len(xs), float(xs[0]), records, places, last

    def resume(state, found):
        n, first, records, places, last = found
        if state is None:
            k = 0 if len(places) and places[0] == 0 else None
            reference, counter, passed = first, 0, n - 1
        else:
            reference, counter, _ = state
            k = int(np.searchsorted(records, reference + tolerance, side="right"))
            k, passed = (k if k < len(records) else None), n
        if k is not None:
            reference, counter, passed = float(records[last[k]]), 0, n - 1 - int(places[last[k]])
        counter = min(counter + passed, limit) if passed else counter
        return reference, counter, counter >= limit

    rows = df.withColumn(value, F.col(value).cast("double"))
    return _fold(rows, group, order, [value], PATIENCE, step, summary, resume)


def adaptive_rate(
    df: DataFrame, group: str, order: str, diversity: str, improved: str, initial: float, low: float, high: float, step: float, threshold: float, reset: bool = True
) -> DataFrame:
    """Adds rate, stagnant and reason after each row.

    The first row starts the rate: `initial` held to [low, high], one step more
    at low diversity (at most `threshold`).  After an improvement the rate goes
    back to `low` where `reset` is set; else it gains a step at low diversity
    and is held otherwise.  Any other row counts as stagnant and adds a step.
    A step that would pass `high` gives exactly `high`.
    """
    up = lambda rate: high if step > high - rate else rate + step
    then = rate_step(initial, low, high, step, threshold, reset)

    # Steps, and what they start from: nothing before a reset matters, and a rate that a step no longer moves stays.
    def summary(ds, better):
        ds, better = ds[1:].astype(float), better.astype(bool)
        head, better = bool(better[0]), better[1:]
        poor = ds <= threshold
        resets = np.flatnonzero(better) if reset else np.zeros(0, dtype=np.int64)
        since = int(resets[-1]) + 1 if len(resets) else 0
        better_at = np.flatnonzero(better)
        ups = int((~better[since:] | poor[since:]).sum())
        return head, len(resets) > 0, ups, len(better_at) > 0, len(better) - (int(better_at[-1]) + 1 if len(better_at) else 0)

    def whole(ds, better):
        return float(ds[0]), *summary(ds, better)

    def resume(state, found):
        first, head, was_reset, ups, was_better, tail = found
        rate, stagnant, reason = then(state, first, head)
        rate = low if was_reset else rate
        for _ in range(ups):
            moved = up(rate)
            if moved == rate:
                break
            rate = moved
        return rate, tail if was_better else stagnant + tail, reason

    rows = df.withColumn(improved, F.coalesce(F.col(improved).cast("boolean"), F.lit(False))).withColumn(diversity, F.col(diversity).cast("double"))
    out = _fold(rows, group, order, [diversity, improved], RATE, then, whole, resume)
    return out.select(group, order, "rate", "stagnant", "reason")


def rate_applies(generation_limit: int, population_size: int, elite_count: int | None) -> bool:
    """Whether a run can mutate at all: it has a next generation, and not one row alone that is its own elite."""
    return generation_limit > 0 and (population_size != 1 or elite_count == 0)
