"""Documents, series, ranks and pairs that span many tasks give the rows of one pass."""

import random
import unittest.mock
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import canonical
from lodestone.functions import fingerprint as prints
from lodestone.functions.random import Streams
from lodestone.operators import analysis, folds, genetics, joins, measurement, ordered, population, ranking, streams


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(0, 2**64 - 1))
def test_summaries_of_bytes_compose(pieces, start):
    run = 0, np.zeros(256, dtype=np.uint64)
    for p in pieces:
        run = prints.compose(run, prints.summary(p))
    assert run[0] == sum(map(len, pieces))
    assert prints.applied(start, run) == prints.fnv1a(b"".join(pieces), start)


def test_summary_of_a_long_run():
    data = random.Random(1).randbytes(100_003)
    assert prints.applied(prints.OFFSET, prints.summary(data)) == prints.fnv1a(data)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400))
def test_checksums_combine(one, two):
    assert prints.crc32_combined(zlib.crc32(one), zlib.crc32(two), len(two)) == zlib.crc32(one + two)


def test_a_document_of_many_tasks_has_one_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(canonical, "RAW", 64)
    monkeypatch.setattr(canonical, "GO", 5000)
    rng = random.Random(2)
    rows = [(k, i, rng.choice(["a", "bb", None, "é" * 9, ""])) for k, n in ((1, 5000), (2, 3), (3, 0), (None, 40)) for i in rng.sample(range(10_000), n)]
    rows += rows[:50]  # repeated rows count
    df = spark.createDataFrame(rows, "k long, i long, t string").repartition(7)
    keys = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long").withColumn("head", canonical.text(F.lit("h"))).withColumn("tail", canonical.number(F.lit(7)))
    body = canonical.rows(df, "k", ["i"], F.concat(canonical.number(F.col("i")), canonical.text(F.col("t"))))
    got = {r.k: r.fingerprint for r in canonical.fingerprints(keys, "k", [body, None], "tail").collect()}
    for k in (1, 2, 3, None):
        state = prints.fnv1a_string("h")
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], len((r[2] or "").encode()).to_bytes(8, "little") + (r[2] or "").encode()))
        state = prints.fnv1a_number(len(mine), state)
        for _, i, t in mine:
            state = prints.fnv1a_string(t or "", prints.fnv1a_number(i, state))
        assert got[k] == prints.text_form(prints.fnv1a_number(7, prints.fnv1a_number(0, state)))


def test_checksums_of_chunks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randbytes(rng.randrange(0, 200))) for k in (1, 2) for i in range(2000 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "k long, i long, b binary").repartition(6)
    got = {r.k: (r.size, r.crc32) for r in canonical.checksums(df, "k", ["i"], F.col("b")).collect()}
    for k in (1, 2):
        whole = b"".join(b for x, _, b in sorted(rows) if x == k)
        assert got[k] == (len(whole), zlib.crc32(whole))


# --- ranges, ranks and folds


def one_partition(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SinglePartition" in plan


def test_ranges_are_even_and_stable(spark):
    df = spark.range(20_000).select((F.xxhash64("id") % 1000).alias("a"), F.col("id").cast("string").alias("b"))
    cut = ordered.ranges(df, [F.col("a"), F.col("b")], 16)
    assert cut.borders == ordered.ranges(df.repartition(5), [F.col("a"), F.col("b")], 16).borders
    key = F.struct(F.col("a").alias("_0"), F.col("b").alias("_1"))
    sizes = [r["count"] for r in df.groupBy(cut.of(key)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    rows = df.select("a", "b", cut.of(key).alias("r")).orderBy("a", "b").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows)


def test_total_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1.5, -2.0, 0.0]), rng.choice(["a", "é", None, "b" * 40]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "x double, s string, k long").repartition(5)
    got = ordered.total_rank(df, [F.col("x"), F.col("s"), -F.col("k")], "rank")
    assert not one_partition(got)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode(), -r[2])
    assert [r.k for r in got.orderBy("rank").collect()] == [r[2] for r in sorted(rows, key=key)]
    assert sorted(r["rank"] for r in got.collect()) == list(range(3000))
    assert ordered.total_rank(df.limit(0), [F.col("k")], "rank").count() == 0


def plain_patience(xs, tolerance, limit):
    out, reference, counter = [], None, 0
    for x in xs:
        if reference is None or x > reference + tolerance:
            reference, counter = x, 0
        else:
            counter = min(counter + 1, limit)
        out.append((reference, counter, counter >= limit))
    return out


SERIES = {
    "random": lambda r, n: [r.choice([0.0, 1.0, 2.5, 7.0, 7.5]) + r.random() for _ in range(n)],
    "rising": lambda r, n: [k * 0.3 for k in range(n)],
    "falling": lambda r, n: [-float(k) for k in range(n)],
    "steps": lambda r, n: [float(k // 50) for k in range(n)],
    "flat": lambda r, n: [1.0] * n,
}


@pytest.mark.parametrize("kind", SERIES)
@pytest.mark.parametrize("tolerance,limit", [(0.0, 5), (1.0, 3), (40.0, 700), (2.0, 0)])
def test_patience_of_one_long_group_is_that_of_one_pass(spark, kind, tolerance, limit):
    rng = random.Random(7)
    groups = {1: SERIES[kind](rng, 900), 2: SERIES[kind](rng, 3), None: SERIES[kind](rng, 300)}
    df = spark.createDataFrame([(g, k, x) for g, xs in groups.items() for k, x in enumerate(xs)], "g long, k long, x double").repartition(5)
    got = folds.patience(df, "g", "k", "x", tolerance, limit)
    for g, xs in groups.items():
        mine = got.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("k").collect()
        assert [(r.reference, r.counter, r.stagnated) for r in mine] == plain_patience(xs, tolerance, limit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(-5, 5) | st.sampled_from([0.0, 1.0, 1.0, -np.inf, np.inf]), min_size=1, max_size=40), st.lists(st.integers(1, 39), max_size=5, unique=True), st.sampled_from([0.0, 0.5, 3.0]), st.integers(0, 6))
def test_patience_summaries_resume(xs, cuts, tolerance, limit):
    held = {}
    with unittest.mock.patch.object(folds, "_fold", lambda df, g, o, v, states, step, summary, resume: held.update(summary=summary, resume=resume)):
        folds.patience(unittest.mock.MagicMock(), "g", "k", "x", tolerance, limit)
    state, borders = None, [0, *sorted(c for c in cuts if c < len(xs)), len(xs)]
    want = plain_patience(xs, tolerance, limit)
    for i, j in zip(borders, borders[1:]):
        state = held["resume"](state, held["summary"](np.array(xs[i:j])))
        assert state == want[j - 1]


@pytest.mark.parametrize("reset", [True, False])
def test_adaptive_rate_of_one_long_group_is_that_of_one_pass(spark, reset):
    rng = random.Random(9)
    rows = [(g, k, rng.random(), rng.random() < share) for g, n, share in (("a", 900, 0.02), ("b", 2, 0.5), ("c", 400, 0.0), ("d", 300, 0.6)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, d double, better boolean").repartition(5)
    got = {(r.g, r.k): (r.rate, r.stagnant, r.reason) for r in folds.adaptive_rate(df, "g", "k", "d", "better", 0.2, 0.1, 0.9, 0.013, 0.3, reset).collect()}
    up = lambda r: 0.9 if 0.013 > 0.9 - r else r + 0.013
    for g in "abcd":
        rate, stagnant = None, 0
        for _, k, d, better in sorted(r for r in rows if r[0] == g):
            low = d <= 0.3
            if rate is None:
                rate, reason = (up(0.2), "low-diversity") if low else (0.2, "initial")
            elif not better:
                rate, stagnant, reason = up(rate), stagnant + 1, "stagnation-low-diversity" if low else "stagnation"
            elif reset:
                rate, stagnant, reason = 0.1, 0, "improvement-reset"
            else:
                rate, stagnant, reason = up(rate) if low else rate, 0, "low-diversity" if low else "improvement-hold"
            assert got[g, k] == (rate, stagnant, reason)


def test_a_long_group_is_folded_by_many_tasks(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.rand(3).alias("x"))
    tasks = folds.patience(df, "g", "k", "x", 0.0, 5).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 2500


# --- tickets and pairs


def test_tickets_meet_intervals_in_buckets(spark):
    rng = random.Random(4)
    intervals, draws = [], []
    for g, n in ((1, 500), (2, 1), (None, 7), (3, 40)):
        at = 0
        for k in range(n):
            size = rng.choice([0, 1, 1, 2, 1000 if g == 3 else 3])
            intervals.append((g, k, at, at + size))
            at += size
        draws += [(g, rng.randrange(at + 2)) for _ in range(300)] if at else []
    i = spark.createDataFrame(intervals, "g long, population_index long, ticket_from long, ticket_to long")
    d = spark.createDataFrame(draws, "g long, ticket long")
    got = sorted((tuple(r) for r in ranking.pick_by_ticket(i, d, "g", "ticket").select("g", "ticket", "population_index").collect()), key=str)
    want = [(g, t, k) for g, t in draws for h, k, a, b in intervals if h == g and a <= t < b]
    assert got == sorted(want, key=str)
    own = d.where("g = 1").select("ticket")
    placed = genetics.place_tickets(own, i.where("g = 1").drop("g"))
    assert not one_partition(placed) and sorted(map(tuple, placed.collect())) == sorted((t, k) for g, t, k in want if g == 1)


def test_tiles_make_every_pair_once(spark):
    rng = random.Random(6)
    rows = [(g, k, rng.random()) for g, n in ((1, 61), (2, 2), (3, 1), (None, 9)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, x double")
    for tile in (4, 7, 512):
        got = {r.g: (r.pair_count, r.diversity) for r in population.pair_diversity(df, "g", "i", F.col("a.x") - 2 * F.col("b.x"), 1 << 20, 1, tile).collect()}
        for g in (1, 2, None):
            xs = [x for h, _, x in rows if h == g]
            pairs = [a - 2 * b for n, b in enumerate(xs) for a in xs[:n]]
            assert got[g][0] == len(pairs) and abs(got[g][1] - sum(pairs) / len(pairs)) < 1e-9
        assert 3 not in got


def test_opportunities_are_ranked_without_one_task(spark):
    missed = spark.range(500).select((F.col("id") % 37).cast("string").alias("loc"))
    runtime = spark.range(60).select((F.col("id") % 11).cast("string").alias("loc"), F.col("id").alias("n"))
    got = analysis.opportunities(missed, runtime, "loc", "n")
    assert not one_partition(got)
    rows = got.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 38))
    key = [(not r.runtime_evidence_present, -r.runtime_sample_count, -r.missed_optimization_count, r["loc"]) for r in rows]
    assert key == sorted(key)


# --- quality of streams


def test_schedules_are_those_of_the_generator(spark):
    rng = random.Random(5)
    rows = [(rng.getrandbits(63), rng.randrange(9), rng.randrange(9), rng.randrange(1, 5)) for _ in range(200)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "seed long, generation long, population_index long, domain long").withColumn("g", F.lit(1))
    got = streams.with_schedule(df, "seed", "domain", "a", "b").select("*", streams.first_word(F.col("a")).alias("w")).collect()
    for r in got:
        s = Streams.derived(r.seed, r.generation, np.array([r.population_index]), r.domain)
        assert (int(s.state[0]), int(s.increment[0])) == (r.a % 2**64, r.b % 2**64) and int(s.word(np.array([0]))[0]) == r.w
    assert tuple(streams.collisions(df, "g").first()) == (1, 203, 3)
    whole = streams.avalanche(df.limit(20)).collect()
    assert sum(r.pairs for r in whole) == 20 * 64 and 60 < sum(r.changed_bits for r in whole) / (20 * 64) < 68
    rel = streams.domain_relation(df, [(2, 3), (2, 2)]).orderBy("right_domain").collect()
    assert (rel[0].right_domain, rel[0].changed_bits, round(rel[0].correlation, 9)) == (2, 0, 1.0) and abs(rel[1].correlation) < 0.3


# --- pairs of contents


def test_copies_are_weights_and_tiles_meet_once(spark, monkeypatch):
    monkeypatch.setattr(population, "_STRIP", 3)
    rng = random.Random(8)
    words = [rng.randbytes(4) for _ in range(30)] + [None, b"ab", b""]
    rows = [(g, rng.choice(words)) for g, n in ((1, 90), (2, 2), (3, 1), (None, 9)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g long, c binary")

    def far(a, b):
        return 0.0 if a is None or b is None else sum(a[k : k + 1] != b[k : k + 1] for k in range(4)) / 4

    for tile in (4, 7, 4096):
        got = {r.g: (r.pair_count, r.diversity) for r in population.content_diversity(df, "g", "c", population.byte_distance(4), 1 << 20, 1, tile).collect()}
        assert set(got) == {1, 2, None}
        for g in got:
            cs = [c for h, c in rows if h == g]
            pairs = [far(a, b) for n, b in enumerate(cs) for a in cs[:n]]
            assert got[g][0] == len(pairs) and abs(got[g][1] - sum(pairs) / len(pairs)) < 1e-12


def test_copies_are_no_work_of_pairs(spark):
    """4,000 copies of two genomes are one pair of contents: within a budget that their own pairs pass by far."""
    df = spark.range(4000).select(F.lit(1).alias("g"), F.when(F.col("id") % 4 == 0, F.lit("ab")).otherwise(F.lit("ac")).cast("binary").alias("c"))
    got = population.content_diversity(df, "g", "c", population.byte_distance(2), 1).first()
    assert (got.pair_count, got.diversity) == (4000 * 3999 // 2, 1000 * 3000 / 2 / (4000 * 3999 // 2))
    with pytest.raises(ValueError):
        population.content_diversity(df, "g", "c", population.byte_distance(2), 0)


def test_vectors_near_alike_and_undefined(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20, 8))
    vectors = [v.tolist() for v in base] + [(v * (1 + 1e-9)).tolist() for v in base[:5]] + [base[0].tolist(), base[1, :7].tolist(), None, [None] * 8]
    df = spark.createDataFrame([(1, v) for v in vectors], "g long, v array<double>")

    def far(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        return float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) / 2

    pairs = [far(a, b) for n, b in enumerate(vectors) for a in vectors[:n]]
    known = [d for d in pairs if d is not None]
    for tile in (5, 4096):
        got = population.content_diversity(df, "g", "v", population.euclidean_distance(0.5), 1 << 20, 1, tile).first()
        assert got.pair_count == len(pairs) and abs(got.diversity - sum(known) / len(known)) < 1e-12
    x = population.euclidean_distance(0.5)
    near = x.between(x.pack([base[0].tolist()]), x.pack([(base[0] * (1 + 1e-9)).tolist()]))[0][0, 0]
    assert abs(near / far(base[0].tolist(), (base[0] * (1 + 1e-9)).tolist()) - 1) < 1e-12


def test_flipped_bits_are_counted_in_their_tasks(spark):
    """64 flips of 50,000 seeds are counted before a row leaves a task, nulls as pairs without a number of changed bits."""
    df = spark.range(50_000, numPartitions=2).select(F.when(F.col("id") > 0, F.col("id") * 7919).alias("seed"), (F.col("id") % 5).alias("generation"), (F.col("id") % 3).alias("population_index"), F.lit(2).alias("domain"))
    got = streams.avalanche(df)
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.bucket: (r.pairs, r.changed_bits) for r in got.collect()}
    assert sum(n for n, _ in rows.values()) == 50_000 * 64 and rows[16][0] >= 64
    some = df.where("seed < 7919 * 40").collect()
    want = {}
    for t in some:
        a = Streams.derived(t.seed, [t.generation], [t.population_index], 2)
        for bit in range(64):
            b = Streams.derived(t.seed ^ (1 << bit), [t.generation], [t.population_index], 2)
            n = bin(int(a.state[0]) ^ int(b.state[0])).count("1") + bin(int(a.increment[0]) ^ int(b.increment[0])).count("1")
            k = min(n // 8, 16)
            want[k] = want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n
    assert {r.bucket: (r.pairs, r.changed_bits) for r in streams.avalanche(df.where("seed < 7919 * 40")).collect()} == want


# --- measurement


def test_medians_keep_samples_where_they_are(spark):
    """Few workloads: no exchange of the samples by their keys, and only values around the middle are counted by value."""
    n = 20_000
    rows = spark.range(n, numPartitions=4).select((F.col("id") % 2).cast("string").alias("workload"), F.lit("baseline").alias("subject"), F.lit("recorded").alias("phase"), *[F.lit(v).alias(c) for c, v in (("condition_ok", True), ("completed", True), ("timed_out", False), ("failed", False))], F.col("id").alias("runtime_ns"))
    marked = measurement.mark_outliers(rows, 100)
    assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()
    got = {r.workload: r.n for r in marked.where("exclusion is null").groupBy("workload").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {w: sum(abs(k - (n // 2 - 1 + int(w))) <= 100 for k in range(int(w), n, 2)) for w in ("0", "1")}
    near = measurement._around_middle(rows, ["workload"], ["runtime_ns"])
    assert near.count() < n / 20 and {r._n for r in near.select("_n").collect()} == {n // 2}


def measured(spark, n):
    """n recorded samples of each of two workloads and both subjects; no two values of a group are equal."""
    rows = spark.range(4 * n, numPartitions=4)
    sides = F.when(F.col("id") % 4 < 2, "baseline").otherwise("candidate")
    value = F.col("id").bitwiseAND(F.lit(~3)).cast("long")
    fine = [F.lit(v).alias(c) for c, v in (("condition_ok", True), ("completed", True), ("timed_out", False), ("failed", False))]
    return rows.select((F.col("id") % 2).cast("string").alias("workload"), sides.alias("subject"), F.lit("recorded").alias("phase"), *fine, (value + 1000).alias("runtime_ns"), (value * 3 + 1).alias("peak_memory"), (-value).alias("binary_size"))


MEASURES = ["runtime_ns", "peak_memory", "binary_size"]


@pytest.mark.parametrize("many", [True, False])
def test_bounds_of_a_median_are_found_once(spark, monkeypatch, many):
    """A sketch depends on the order in which its parts meet: two of one group may differ, and a median be off by the rows between."""
    monkeypatch.setattr(joins, "FEW", 1 if many else 100)
    near = measurement._around_middle(measured(spark, 100), ["workload", "subject"], MEASURES)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("percentile_approx(") == int(many)


def written_records(spark, run):
    """What run() returns, and the rows that its stages wrote to shuffles."""

    def stages():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        some = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(some.apply, range(some.size()))}

    held = stages()
    got = run()
    return got, sum(n for k, n in stages().items() if k not in held)


def compared(samples, max_range):
    marked = measurement.mark_outliers(samples, 10**9)
    return measurement.compare_workloads(marked, measurement.aggregate_subjects(marked, MEASURES), 1000, 5000, max_range, 3)


@pytest.mark.parametrize("max_range,failed,want", [
    (10_000_000, -1, "equal"),
    (10, -1, "unstable"),
    (10_000_000, 1000, "incomplete"),
])
def test_comparisons_keep_samples_where_they_are(spark, max_range, failed, want):
    """Few groups: what is dealt out by their keys is far less than the samples, though all values differ."""
    n = 10_001
    samples = measured(spark, n).withColumn("failed", F.col("runtime_ns") == failed)
    got, moved = written_records(spark, lambda: compared(samples, max_range).collect())
    assert {(r.workload, r.comparison, r.stable) for r in got} == {(w, want, want == "equal") for w in ("0", "1")}
    assert moved < n


def test_overall_keeps_samples_where_they_are(spark):
    n = 10_001
    got, moved = written_records(spark, lambda: measurement.overall(compared(measured(spark, n), 10_000_000)).collect())
    assert [tuple(r) for r in got] == [("equal", 0.0, True)]
    assert moved < n


def test_fitness_keeps_samples_where_they_are(spark):
    n = 10_001
    run = lambda: measurement.weighted_fitness(compared(measured(spark, n), 10_000_000).withColumn("weight", F.lit(2.0)), {"correctness": 0.4, "performance": 0.4}, order="workload").collect()
    got, moved = written_records(spark, run)
    assert [(r.performance, r.memory_use, r.total, r.fitness_available) for r in got] == [(0.0, 0.0, 0.4, True)]
    assert moved < n


def test_aggregates_keep_samples_where_they_are(spark):
    n = 10_001
    got, moved = written_records(spark, lambda: measurement.aggregate_subjects(measurement.mark_outliers(measured(spark, n), None), MEASURES).collect())
    assert {(r.workload, r.subject): (r.included_count, r.runtime_ns, r.peak_memory, r.binary_size) for r in got} == {(w, s): (n, 2 * n + 998, 6 * n - 5, 2 - 2 * n) for w in ("0", "1") for s in ("baseline", "candidate")}
    assert moved < n


def test_values_around_a_median_are_few(spark):
    """One task orders a group's values between the bounds: they are a five-hundredth of it, and the middle is well among them."""
    n = 50_000
    near = measurement._around_middle(measured(spark, n).repartition(20, "runtime_ns"), ["workload", "subject"], MEASURES)
    groups = near.groupBy("workload", "subject", "_m").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.count("_v").alias("c")).collect()
    assert len(groups) == 12
    for g in groups:
        assert n * 0.4985 < g.lo < n * 0.4995 and n * 0.5005 < g.hi < n * 0.5015 and g.c == g.hi - g.lo


@pytest.mark.parametrize("n", [1, 2, 3, 4, 499, 500, 501, 1000, 1001])
def test_bounds_hold_the_middle_of_any_count(spark, n):
    rows = spark.range(n, numPartitions=3).select(F.lit(0).alias("g"), (F.col("id") * 10).alias("v"))
    assert measurement.integer_medians(rows, ["g"], ["v"]).first().v == 5 * (n - 1)


def test_medians_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 5)
    rng = random.Random(10)
    rows = [(k, rng.randrange(-(2**62), 2**62)) for k in range(40) for _ in range(1 + k % 4)]
    got = {r.k: r.v for r in measurement.integer_medians(spark.createDataFrame(rows, "k long, v long"), ["k"], ["v"]).collect()}
    for k in range(40):
        v = sorted(x for h, x in rows if h == k)
        assert got[k] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) // 2


# --- rules of tables


def test_references_of_few_values_do_not_gather_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(3000, numPartitions=3).select(F.col("id").cast("string").alias("identity"), (F.col("id") % 3).alias("few"), (F.col("id") % 7).alias("used"), F.col("id").alias("many"))
    parents = spark.range(1, 2000).select(F.col("id").alias("p")), spark.createDataFrame([(0,), (2,), (2,), (None,)], "p long")
    got = analysis.record_problems(rows, [("fine", F.lit(True))], [("few", "few", parents[1], "p"), ("used", "used", parents[0], "p"), ("many", "many", parents[0], "p")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(few" not in plan and "hashpartitioning(used" not in plan and "hashpartitioning(many" in plan
    want = {str(i): "few" if i % 3 == 1 else "used" if i % 7 == 0 else "many" for i in range(3000) if i % 3 == 1 or i % 7 == 0 or not 1 <= i < 2000}
    assert {r.identity: r.problem for r in got.collect()} == want


def test_a_catalogue_is_numbered_in_many_tasks(spark):
    import lodestone.queries  # noqa: F401
    from lodestone import catalog

    assert not one_partition(catalog.QUERIES["catalogue_rules"](spark, "/root/testdata/sf0.001"))


def test_product_checkpoints_are_made_once_in_many_tasks(spark):
    import lodestone.queries  # noqa: F401
    from lodestone import catalog

    plan = catalog.QUERIES["product_checkpoints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2 and "REPARTITION_BY_NUM" in plan
