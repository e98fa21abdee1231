"""Unsigned arithmetic, random streams, genetic operators, fingerprints and the generation loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.functions import fingerprint, u64
from lodestone.functions.random import CROSSOVER, MUTATION, SELECTION, Streams
from lodestone.operators import genetics, streams
from lodestone.plans import run as plan

from . import _sql
from ._tables import scratch, table

_P = "18446744073709551616::UHUGEINT"
_MIX = f"""
WITH a AS (SELECT c_custkey, CAST(c_custkey AS UBIGINT) AS x0 FROM customer),
b AS (SELECT c_custkey, CAST((CAST(xor(x0, x0 >> 30) AS UHUGEINT) * 13787848793156543929::UHUGEINT) % {_P} AS UBIGINT) AS x1 FROM a),
c AS (SELECT c_custkey, CAST((CAST(xor(x1, x1 >> 27) AS UHUGEINT) * 10723151780598845931::UHUGEINT) % {_P} AS UBIGINT) AS x2 FROM b)
SELECT c_custkey, printf('%016x', xor(x2, x2 >> 31)) AS mixed FROM c
"""


@query(_MIX)
def mix64_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", u64.hex16(u64.mix64(F.col("c_custkey"))).alias("mixed"))


@query(f"""
WITH s AS (SELECT p_partkey, CAST((((CAST(1442695040888963407 AS UHUGEINT) + CAST(p_partkey AS UHUGEINT)) % {_P}) * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % {_P} AS UBIGINT) AS state FROM part),
w AS (SELECT p_partkey, state, (xor(state >> 18, state) >> 27) & 4294967295::UBIGINT AS x, state >> 59 AS r FROM s)
SELECT p_partkey, CAST(((x >> r) | (x << ((32::UBIGINT - r) & 31::UBIGINT))) & 4294967295::UBIGINT AS BIGINT) AS word FROM w
""")
def pcg_words(spark, sf_dir):
    """The first word of the generator seeded by each key."""

    def run(parts):
        for part in parts:
            s = Streams.seeded(part["p_partkey"])
            yield pd.DataFrame({"p_partkey": part["p_partkey"], "word": s.word(np.arange(len(part))).astype("int64")})

    return table(spark, sf_dir, "part").select("p_partkey").mapInPandas(run, "p_partkey long, word long")


def _draws_sql() -> str:
    c = _sql.Chain("customer")
    draw = c.stream(42, 7, "c_custkey", SELECTION).uniform(1000)
    event = c.stream(42, 7, "c_custkey", MUTATION).event(0.35)
    return f"SELECT c_custkey, {draw} AS draw, {event} AS event FROM ({c.sql()})"


@query(_draws_sql())
def uniform_draws(spark, sf_dir):
    """An unbiased draw below 1000 and a probability event for each customer, from derived streams."""

    def run(parts):
        for part in parts:
            key, every = part["c_custkey"].to_numpy(), np.arange(len(part))
            a, b = Streams.derived(42, 7, key, SELECTION), Streams.derived(42, 7, key, MUTATION)
            yield pd.DataFrame({"c_custkey": key, "draw": a.uniform(every, 1000).astype("int64"), "event": b.event(every, 0.35)})

    return table(spark, sf_dir, "customer").select("c_custkey").mapInPandas(run, "c_custkey long, draw long, event boolean")


def _tickets_sql(source: str, offspring: str, bound: str, draws: int) -> str:
    """pair, parent, draw, ticket of all pairs; source has one row for each pair."""
    c = _sql.Chain(source)
    stream = c.stream(42, 7, "pair", SELECTION)
    rows = [f"SELECT pair, {parent} AS parent, {draw} AS draw, {stream.uniform(bound)} AS ticket FROM drawn WHERE 2 * pair + {parent} < {offspring}" for parent in (0, 1) for draw in range(draws)]
    return f"drawn AS ({c.sql()}), tickets AS ({' UNION ALL '.join(rows)})"


_PAIRS = "pairs AS (SELECT CAST(pair AS BIGINT) AS pair, n, m FROM (SELECT count(*) AS n, @M@ AS m FROM @FROM@) AS s, range(0, 1000000) AS r(pair) WHERE pair < (n + 1) // 2)"


@query(f"""
WITH {_PAIRS.replace("@M@", "count(*) + count(*) * (count(*) - 1) // 2").replace("@FROM@", "supplier")}, {_tickets_sql("pairs", "n", "m", 1)},
w AS (SELECT s_suppkey, count(*) OVER () - row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) + 1 AS weight FROM supplier),
i AS (SELECT s_suppkey, weight, sum(weight) OVER (ORDER BY s_suppkey) AS hi FROM w)
SELECT pair, CAST(parent AS INTEGER) AS parent, ticket, s_suppkey AS population_index FROM tickets JOIN i ON ticket >= hi - weight AND ticket < hi
""")
def selection_pairs(spark, sf_dir):
    """Rank-selected parents: tickets placed among the weights of the suppliers by balance."""
    from lodestone.operators.ranking import rank_intervals

    rows = table(spark, sf_dir, "supplier").select(F.lit(0).alias("g"), F.col("s_suppkey").alias("population_index"), F.col("s_acctbal").alias("total"))
    n = rows.count()
    intervals = rank_intervals(rows, "g", "population_index", "total")
    tickets = genetics.parent_tickets(spark.range((n + 1) // 2), 42, 7, n, n + n * (n - 1) // 2)
    return genetics.place_tickets(tickets, intervals).select("pair", "parent", "ticket", "population_index")


@query(f"""
WITH {_PAIRS.replace("@M@", "count(*)").replace("@FROM@", "supplier WHERE s_acctbal > 0")}, {_tickets_sql("pairs", "n", "m", 3)},
o AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal FROM supplier WHERE s_acctbal > 0),
b AS (SELECT pair, parent, s_suppkey, row_number() OVER (PARTITION BY pair, parent ORDER BY s_acctbal DESC, s_suppkey) AS k FROM tickets JOIN o ON ticket = ordinal)
SELECT pair, CAST(parent AS INTEGER) AS parent, s_suppkey AS population_index FROM b WHERE k = 1
""")
def tournament_pairs(spark, sf_dir):
    """Tournament-selected parents: three draws with replacement among the valid suppliers, the best one wins."""
    from lodestone.operators.ranking import valid_ordinals

    rows = table(spark, sf_dir, "supplier").select(F.lit(0).alias("g"), F.col("s_suppkey").alias("population_index"), F.col("s_acctbal").alias("total"))
    ordinals = valid_ordinals(rows, "g", "population_index", F.col("total") > 0)
    n = ordinals.count()
    tickets = genetics.parent_tickets(spark.range((n + 1) // 2), 42, 7, n, n, 3)
    met = tickets.join(ordinals, tickets.ticket == ordinals.ordinal)
    return met.groupBy("pair", "parent").agg(F.max_by("population_index", F.struct(F.col("total"), -F.col("population_index"))).alias("population_index"))


#: Bytes of a genome: names are filled with blanks to it, and none is as long.
_WIDTH = 32


def _crossed_sql(kind: str) -> str:
    n = _WIDTH
    c = _sql.Chain("parents")
    stream = c.stream(42, 7, "pair", CROSSOVER)
    hit = stream.event(0.75)
    if kind == "one-point":
        cut = c.let(f"1 + {stream.uniform(n - 1)}")
        swapped = f"i - 1 >= {cut}"
    elif kind == "two-point":
        first, second = stream.uniform(n + 1), stream.uniform(n)
        second = c.let(f"{second} + CASE WHEN {second} >= {first} THEN 1 ELSE 0 END")
        swapped = f"i - 1 >= least({first}, {second}) AND i - 1 < greatest({first}, {second})"
    elif kind == "uniform":
        word = stream.word()
        swapped = f"((CAST({word} AS BIGINT) >> CAST(i - 1 AS INTEGER)) & 1) = 1"
    else:
        swapped = "false"
    take = lambda own, other: c.let(f"list_transform(range(1, {n + 1}), lambda i: CASE WHEN {hit} AND b IS NOT NULL AND ({swapped}) THEN {other}[i] ELSE {own}[i] END)")
    one, two = take("a", "b"), take("b", "a")
    m = _sql.Chain("born")
    stream = m.stream(42, 7, "population_index", MUTATION)
    hit, place, mask = stream.event(0.35), stream.uniform(n), stream.uniform(255)
    genome = m.let(f"array_to_string(list_transform(range(1, {n + 1}), lambda i: printf('%02X', CASE WHEN {hit} AND i - 1 = {place} THEN xor(genome[i], 1 + {mask}) ELSE genome[i] END)), '')")
    return f"""
WITH names AS (SELECT p_partkey, (p_partkey - 1) // 2 AS pair, {_sql.ascii_bytes(f"rpad(p_name, {n}, ' ')")} AS g FROM part),
parents AS (SELECT pair, min_by(g, p_partkey) AS a, max_by(g, p_partkey) AS b FROM names GROUP BY pair),
crossed AS ({c.sql()}),
born AS (SELECT 2 * pair AS population_index, {one} AS genome FROM crossed UNION ALL SELECT 2 * pair + 1, {two} FROM crossed),
mutated AS ({m.sql()})
SELECT population_index, {genome} AS genome FROM mutated"""


def _crossed(spark, sf_dir, kind: str):
    names = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.rpad("p_name", _WIDTH, " "), "utf-8").alias("genome"))
    pair = F.expr("(p_partkey - 1) div 2")
    parents = names.groupBy(pair.alias("pair")).agg(F.min_by("genome", "p_partkey").alias("a"), F.max_by("genome", "p_partkey").alias("b"))
    out = genetics.children(parents, 42, 7, 1 << 40, 0.75, kind, 0.35)
    return out.select("population_index", F.hex("genome").alias("genome"))


@query(_crossed_sql("one-point"))
def crossover_one_point(spark, sf_dir):
    return _crossed(spark, sf_dir, "one-point")


@query(_crossed_sql("two-point"))
def crossover_two_point(spark, sf_dir):
    return _crossed(spark, sf_dir, "two-point")


@query(_crossed_sql("uniform"))
def crossover_uniform(spark, sf_dir):
    return _crossed(spark, sf_dir, "uniform")


@query(_crossed_sql("clone"))
def crossover_clone_mutate(spark, sf_dir):
    return _crossed(spark, sf_dir, "clone")


_FNV = f"""
SELECT p_partkey, 'fnv1a64-v1:' || printf('%016x', CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(p_name) + 1), lambda i: CAST(ascii(p_name[i]) AS UHUGEINT))),
       lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211::UHUGEINT) % {_P}) AS UBIGINT)) AS fingerprint FROM part
"""


@query(_FNV)
def fnv1a_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fingerprint.fnv1a_text("p_name").alias("fingerprint"))


@query(_FNV)
def fnv1a_column(spark, sf_dir):
    """The same by SQL functions alone."""
    codes = F.transform(F.split("p_name", ""), lambda c: F.ascii(c))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("fnv1a64-v1:"), u64.hex16(fingerprint.fold_column(codes))).alias("fingerprint"))


# The published course of the bit-count search with seed 0: best totals and diversity in millionths.
_ONEMAX_BEST = (76, 78, 80, 84, 85, 85, 92, 92, 94, 94, 96, 96, 101)
_ONEMAX_DIVERSITY = (994330, 962072, 910156, 844128, 737399, 577747, 510837, 456149, 442288, 393523, 375882, 318170, 342238)
_ONEMAX = ", ".join(f"({g}, {b}.0, {b}.0, {d})" for g, (b, d) in enumerate(zip(_ONEMAX_BEST, _ONEMAX_DIVERSITY)))


@query(f"SELECT CAST(g AS BIGINT) AS generation, CAST(a AS DOUBLE) AS generation_best, CAST(b AS DOUBLE) AS global_best, CAST(d AS BIGINT) AS diversity_millionths FROM (VALUES {_ONEMAX}) AS t(g, a, b, d)")
def onemax_run(spark, sf_dir):
    """Bit-count search over 12 generations of 32 genomes: one row per generation."""
    config = plan.Config(32, 16, 12, 0, elite_count=2, adaptive=True, adaptive_min=0.1, adaptive_max=0.8, adaptive_step=0.1, adaptive_threshold=0.35, adaptive_reset=True)
    state = plan.run(spark, plan.Problem(fitness=plan.popcount("genome", 16)), config, scratch(spark))
    rows = [(h["generation"], float(h["generation_best"]), float(h["global_best"]), round(h["diversity"] * 1e6)) for h in state.history]
    return spark.createDataFrame(rows, "generation long, generation_best double, global_best double, diversity_millionths long")


# --- quality of streams


def _tuples(spark, sf_dir):
    """Customers as tuples; every seventh has the seed of the one after it, and so its other parts too."""
    k = F.col("c_custkey")
    seed = k + F.when(k % 7 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "customer").select(seed.alias("seed"), (seed % 5).alias("generation"), (seed % 11).alias("population_index"), F.lit(SELECTION).alias("domain"))


_TUPLES = f"(SELECT s AS seed, s % 5 AS generation, s % 11 AS population_index, {SELECTION} AS domain FROM (SELECT *, c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS s FROM customer))"


def _schedules(chain, seed: str, domain) -> tuple[str, str]:
    stream = chain.stream(seed, "generation", "population_index", domain)
    return stream.state, stream.increment


def _collision_sql() -> str:
    chain = _sql.Chain(_TUPLES)
    state, increment = _schedules(chain, "seed", "domain")
    return f"WITH e AS (SELECT population_index, {state} AS a, {increment} AS b, count(*) AS n FROM ({chain.sql()}) GROUP BY ALL) SELECT population_index, CAST(sum(n) AS BIGINT) AS tuples, CAST(sum(n - 1) AS BIGINT) AS collisions FROM e GROUP BY 1"


@query(_collision_sql())
def schedule_collisions(spark, sf_dir):
    return streams.collisions(_tuples(spark, sf_dir), "population_index")


def _avalanche_sql() -> str:
    chain = _sql.Chain(f"(SELECT t.*, xor(CAST(seed AS UBIGINT), 1::UBIGINT << CAST(bit AS UBIGINT)) AS flipped FROM {_TUPLES} AS t, range(0, 64) AS b(bit))")
    (a, b), (c, d) = _schedules(chain, "seed", "domain"), _schedules(chain, "flipped", "domain")
    changed = f"bit_count(xor({a}, {c})::BIT) + bit_count(xor({b}, {d})::BIT)"
    return f"SELECT CAST(least(d // 8, 16) AS BIGINT) AS bucket, count(*) AS pairs, CAST(sum(d) AS BIGINT) AS changed_bits FROM (SELECT {changed} AS d FROM ({chain.sql()})) GROUP BY 1"


@query(_avalanche_sql())
def seed_avalanche(spark, sf_dir):
    """Changed bits of every tuple's schedule, for each flipped bit of its seed."""
    return streams.avalanche(_tuples(spark, sf_dir))


def _relation_sql() -> str:
    chain = _sql.Chain(f"(SELECT t.*, l, r FROM {_TUPLES} AS t, (VALUES (2, 3), (3, 4)) AS p(l, r))")
    one, two = chain.stream("seed", "generation", "population_index", "l"), chain.stream("seed", "generation", "population_index", "r")
    a, b, c, d = one.state, one.increment, two.state, two.increment
    x, y = one.word(), two.word()
    return f"SELECT CAST(l AS BIGINT) AS left_domain, CAST(r AS BIGINT) AS right_domain, count(*) AS pairs, CAST(sum(bit_count(xor({a}, {c})::BIT) + bit_count(xor({b}, {d})::BIT)) AS BIGINT) AS changed_bits, round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 6) AS correlation FROM ({chain.sql()}) GROUP BY l, r"


@query(_relation_sql())
def domain_relations(spark, sf_dir):
    out = streams.domain_relation(_tuples(spark, sf_dir), [(SELECTION, CROSSOVER), (CROSSOVER, MUTATION)])
    return out.withColumn("correlation", F.round("correlation", 6))
