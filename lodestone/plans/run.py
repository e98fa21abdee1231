"""The generation loop: every step of a generation is one DataFrame job, the driver holds scalars alone.

A generation's population is written to `folder`/generation=k as Parquet; that is
the checkpoint a run resumes from, and what cuts the plan's lineage.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.random import CROSSOVER, MUTATION, Streams, filled_rows
from lodestone.operators import genetics, population, ranking


class ConfigError(ValueError):
    """A configuration that the run refuses before it calls anything."""


@dataclass(frozen=True)
class Config:
    population_size: int
    genome_size: int
    generation_limit: int
    seed: int
    selection: str = "rank"
    tournament_size: int = 0
    rank_base: int = 1
    rank_step: int = 1
    crossover: str = "uniform"
    crossover_rate: float = 0.75
    mutation: str = "byte-xor"
    mutation_rate: float = 0.35
    elite_count: int | None = None
    adaptive: bool = False
    adaptive_min: float = 0.0
    adaptive_max: float = 1.0
    adaptive_step: float = 0.1
    adaptive_threshold: float = 0.0
    adaptive_reset: bool = False
    target_total: float | None = None
    diversity_floor: float | None = None
    patience: int | None = None
    improvement_tolerance: float = 0.0
    diversity_budget: int | None = None
    workers: int = 1

    def validate(self) -> None:
        """Checks in a fixed order: workers, stopping, diversity budget, adaptive mutation, transition."""
        if self.workers < 1:
            raise ConfigError("workers")
        if self.population_size < 1 or self.genome_size < 1 or self.generation_limit < 0:
            raise ConfigError("population")
        for name in ("target_total", "diversity_floor", "improvement_tolerance"):
            v = getattr(self, name)
            if v is not None and not math.isfinite(v):
                raise ConfigError(name)
        if self.improvement_tolerance < 0 or (self.patience is not None and self.patience < 1):
            raise ConfigError("stopping")
        if self.diversity_budget is not None:
            population.check_pair_budget(self.population_size, self.genome_size, self.diversity_budget)
        if self.adaptive and not (0 <= self.adaptive_min <= self.adaptive_max <= 1 and 0 < self.adaptive_step <= 1 and 0 <= self.adaptive_threshold <= 1):
            raise ConfigError("adaptive mutation")
        if self.generation_limit:
            if self.selection not in ("rank", "tournament"):
                raise ConfigError("selection")
            if self.selection == "rank" and (self.rank_base < 1 or self.rank_step < 0):
                raise ConfigError("rank weights")
            if self.selection == "tournament" and not 1 <= self.tournament_size <= self.population_size:
                raise ConfigError("tournament size")
            if self.crossover not in (*genetics.CROSSOVERS, "consumer") or self.mutation not in ("byte-xor", "consumer") or not (0 <= self.crossover_rate <= 1 and 0 <= self.mutation_rate <= 1):
                raise ConfigError("operators")
            if self.elite_count is not None and not 0 <= self.elite_count <= self.population_size:
                raise ConfigError("elites")


@dataclass(frozen=True)
class Problem:
    """What a run is about.

    fitness and valid are expressions over the column genome (binary); evaluate
    is any DataFrame function that adds valid and total instead.  Consumer
    operators work on one row: initialize(slot, genome) -> (genome, events),
    cross(generation, pair, a, b) -> (a, b, events of a, events of b) and
    mutate(generation, slot, rate, genome) -> (genome, events); an event is
    (kind, parent_a, parent_b, result, status).  cross and mutate are used where
    the configuration says "consumer".  distance(a, b) replaces the share of
    differing bytes, within the diversity budget; a and b are column aliases.
    Observers are called with what was committed: observer and stop with the
    generation's statistics, storage and schedule with their rows, checkpoint
    with the path that was written.
    """

    fitness: Column | None = None
    valid: Column | None = None
    evaluate: Callable[[DataFrame], DataFrame] | None = None
    stop: Callable[[dict], bool] | None = None
    observer: Callable[[dict], None] | None = None
    initialize: Callable | None = None
    cross: Callable | None = None
    mutate: Callable | None = None
    distance: Callable[[str, str], Column] | None = None
    storage: Callable[[DataFrame], None] | None = None
    schedule: Callable[[DataFrame], None] | None = None
    checkpoint: Callable[[str], None] | None = None


@dataclass
class State:
    generation: int = 0
    best_total: float = 0.0
    best_generation: int = 0
    best_index: int = 0
    best_genome: bytes = b""
    rate: float = 0.0
    stagnant: int = 0
    reference: float = 0.0
    patience_count: int = 0
    reason: str = "none"
    history: list[dict] = field(default_factory=list)


def initial_population(spark: SparkSession, config: Config) -> DataFrame:
    """(population_index, genome): one continuous seeded byte fill, each row found by jumping ahead."""
    seed, size = config.seed, config.genome_size

    def run(parts):
        for part in parts:
            ids = part["id"].to_numpy()
            yield pd.DataFrame({"population_index": ids, "genome": filled_rows(seed, ids, size)})

    return spark.range(config.population_size).mapInPandas(run, "population_index long, genome binary")


def evaluate(df: DataFrame, problem: Problem) -> DataFrame:
    """Adds valid and total; an invalid row is not evaluated and has total 0."""
    if problem.evaluate is not None:
        return problem.evaluate(df)
    return population.hard_filter(df, problem.valid if problem.valid is not None else F.lit(True), {"total": problem.fitness.cast("double")}).drop("evaluated")


def _initialized(df: DataFrame, problem: Problem) -> DataFrame:
    """The seeded rows after the consumer's initializer, with the events of each row."""
    if problem.initialize is None:
        return df
    own = problem.initialize

    def run(parts):
        for part in parts:
            out = [own(int(i), bytes(g)) for i, g in zip(part["population_index"], part["genome"])]
            yield pd.DataFrame({"population_index": part["population_index"], "genome": [g for g, _ in out], "_events": [json.dumps(e) for _, e in out]})

    return df.mapInPandas(run, "population_index long, genome binary, _events string")


def _metrics() -> list[Column]:
    """Aggregates over a generation's rows: n, valid, b (the best row) and finite."""
    best = F.max_by(F.struct("total", "population_index", "genome"), F.when(F.col("valid"), F.struct(F.col("total"), -F.col("population_index"))))
    finite = F.bool_and(~F.col("valid") | ranking.finite(F.col("total")))
    return [F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), best.alias("b"), finite.alias("finite")]


def _statistics(df: DataFrame, problem: Problem, config: Config, seen: dict | None = None) -> dict:
    """Counts, best row, and diversity of the valid rows; `seen` has what was observed while the rows were written."""
    if seen is None:
        seen = df.agg(*_metrics()).first().asDict()
    if not seen["finite"]:
        raise ArithmeticError("a valid row's fitness is not finite")
    valid = df.where("valid").withColumn("_g", F.lit(0))
    if problem.distance is None:
        diversity = population.byte_diversity(valid, "_g", "genome").select("diversity").collect()
    else:
        budget = config.diversity_budget if config.diversity_budget is not None else 1 << 24
        diversity = population.pair_diversity(valid, "_g", "population_index", problem.distance("a", "b"), budget).select("diversity").collect()
    return {"population": seen["n"], "valid": seen["valid"], "best": seen["b"], "diversity": diversity[0][0] if diversity else 0.0}


def _up(config: Config, rate: float) -> float:
    return config.adaptive_max if config.adaptive_step > config.adaptive_max - rate else rate + config.adaptive_step


def _consumer_children(parents: DataFrame, config: Config, generation: int, offspring: int, rate: float, problem: Problem) -> DataFrame:
    """parents(pair, a, b) -> (population_index, genome, _events) with the consumer's operators, gated by the same events
    of the same streams as the built-in ones."""
    cross = problem.cross if config.crossover == "consumer" else None
    mutate = problem.mutate if config.mutation == "consumer" else None
    seed, gates = config.seed, (config.crossover_rate, rate)

    def run(parts):
        for part in parts:
            if not len(part):
                continue
            pairs = part["pair"].to_numpy()
            every = np.arange(len(part))
            meet = Streams.derived(seed, generation, pairs, CROSSOVER).event(every, gates[0])
            out = []
            for pair, a, b, hit in zip(pairs.tolist(), part["a"], part["b"], meet.tolist()):
                a = bytes(a)
                both = b is not None and 2 * pair + 1 < offspring
                one, two, first, second = a, bytes(b) if both else None, [], []
                if both and hit and cross is not None:
                    one, two, first, second = cross(generation, pair, a, two)
                out += [(2 * pair, one, first)] + ([(2 * pair + 1, two, second)] if both else [])
            slots = np.array([s for s, _, _ in out])
            change = Streams.derived(seed, generation, slots, MUTATION).event(np.arange(len(slots)), gates[1])
            rows = []
            for (slot, genome, events), hit in zip(out, change.tolist()):
                if hit and mutate is not None:
                    genome, more = mutate(generation, slot, gates[1], genome)
                    events = [*events, *more]
                rows.append((slot, genome, json.dumps(events)))
            yield pd.DataFrame(rows, columns=["population_index", "genome", "_events"])

    return parents.mapInPandas(run, "population_index long, genome binary, _events string")


def _next(df: DataFrame, config: Config, state: State, valid: int, problem: Problem) -> DataFrame:
    """The next generation's (population_index, genome): offspring pairs, then the best rows at the end."""
    spark, n, generation = df.sparkSession, config.population_size, state.generation
    elites = min(config.elite_count if config.elite_count is not None else n % 2, valid)
    offspring = n - elites
    candidates = df.where("valid").withColumn("_g", F.lit(0))
    pairs = spark.range((offspring + 1) // 2)
    if config.selection == "rank":
        intervals = ranking.rank_intervals(candidates.select("_g", "population_index", "total"), "_g", "population_index", "total", config.rank_base, config.rank_step)
        bound = valid * config.rank_base + config.rank_step * (valid * (valid - 1) // 2)
        tickets = genetics.parent_tickets(pairs, config.seed, generation, offspring, bound)
        chosen = genetics.place_tickets(tickets, intervals)
    else:
        ordinals = ranking.valid_ordinals(candidates, None, "population_index", F.lit(True)).select("ordinal", "population_index", "total")
        tickets = genetics.parent_tickets(pairs, config.seed, generation, offspring, valid, config.tournament_size)
        met = tickets.join(ordinals, tickets.ticket == ordinals.ordinal)
        chosen = met.groupBy("pair", "parent").agg(F.max_by("population_index", F.struct(F.col("total"), -F.col("population_index"))).alias("population_index"))
    genomes = chosen.select("pair", "parent", "population_index").join(df.select("population_index", "genome"), "population_index")
    parents = genomes.groupBy("pair").agg(F.max(F.when(F.col("parent") == 0, F.col("genome"))).alias("a"), F.max(F.when(F.col("parent") == 1, F.col("genome"))).alias("b"))
    if "consumer" in (config.crossover, config.mutation):
        born = _consumer_children(parents, config, generation, offspring, state.rate, problem)
    else:
        born = genetics.children(parents, config.seed, generation, offspring, config.crossover_rate, config.crossover, state.rate)
    kept = ranking.elites(candidates, "_g", "population_index", "total", elites).select((F.lit(offspring) + F.col("elite_rank")).cast("long").alias("population_index"), "genome")
    return born.unionByName(kept, allowMissingColumns=True) if elites else born


def _commit(config: Config, state: State, stats: dict) -> None:
    """Fold one generation's statistics into the state: best, patience, adaptive rate, reason to stop."""
    first, best = state.generation == 0, stats["best"]
    if first and stats["valid"] == 0:
        raise RuntimeError("no valid candidate in the first generation")
    improved = stats["valid"] > 0 and (first or best["total"] > state.best_total)
    if improved:
        state.best_total, state.best_generation, state.best_index, state.best_genome = best["total"], state.generation, best["population_index"], bytes(best["genome"])
    poor = stats["diversity"] <= config.adaptive_threshold
    if not config.adaptive:
        state.rate = config.mutation_rate
    elif first:
        state.rate = min(max(config.mutation_rate, config.adaptive_min), config.adaptive_max)
        if poor:
            state.rate = _up(config, state.rate)
    elif improved:
        state.stagnant = 0
        state.rate = config.adaptive_min if config.adaptive_reset else _up(config, state.rate) if poor else state.rate
    else:
        state.stagnant += 1
        state.rate = _up(config, state.rate)
    state.reason = "none"
    if stats["valid"] == 0:
        state.reason = "all-invalid"
    else:
        if first:
            state.reference = state.best_total
        elif state.best_total > state.reference + config.improvement_tolerance:
            state.reference, state.patience_count = state.best_total, 0
        elif config.patience is not None and state.patience_count < config.patience:
            state.patience_count += 1
        if config.target_total is not None and state.best_total >= config.target_total:
            state.reason = "converged"
        elif config.diversity_floor is not None and stats["diversity"] <= config.diversity_floor:
            state.reason = "stagnated"
        elif config.patience is not None and not first and state.patience_count >= config.patience:
            state.reason = "stagnated"
        elif state.generation >= config.generation_limit:
            state.reason = "generation-limit"
    state.history.append(
        {
            "generation": state.generation, "valid_count": stats["valid"], "generation_best": best["total"] if best else None, "global_best": state.best_total,
            "diversity": stats["diversity"], "mutation_rate": state.rate, "stagnant": state.stagnant, "improved": improved,
        }
    )


def run(spark: SparkSession, problem: Problem, config: Config, folder: str) -> State:
    """Run from the seeded population to a reason to stop."""
    config.validate()
    return _loop(spark, problem, config, folder, State(), _initialized(initial_population(spark, config), problem))


def resume(spark: SparkSession, problem: Problem, config: Config, folder: str, generation: int) -> State:
    """Go on after a written generation: the same rows and state as an uninterrupted run; it is not announced again.

    Statistics are taken anew from the rows and must be those that were written.
    """
    config.validate()
    raw = spark.read.json(f"{folder}/state={generation}").first()["state"]
    saved = json.loads(raw)
    own = {k: v for k, v in asdict(config).items() if k != "generation_limit"}
    if saved.pop("config") != own:
        raise ConfigError("the checkpoint was written with another configuration")
    saved["best_genome"] = bytes.fromhex(saved["best_genome"])
    state = State(**saved)
    df = spark.read.parquet(f"{folder}/generation={generation}")
    stats, told = _statistics(df, problem, config), state.history[-1]
    now = {"generation": generation, "valid_count": stats["valid"], "generation_best": stats["best"]["total"] if stats["best"] else None, "diversity": stats["diversity"]}
    if any(told[k] != v for k, v in now.items()):
        raise ConfigError("the checkpoint's statistics are not those of its population")
    state.generation += 1
    return _loop(spark, problem, config, folder, state, _next(df, config, _before(state), df.where("valid").count(), problem))


def _before(state: State) -> State:
    return State(generation=state.generation - 1, rate=state.rate)


def _loop(spark: SparkSession, problem: Problem, config: Config, folder: str, state: State, born: DataFrame) -> State:
    while True:
        path = f"{folder}/generation={state.generation}"
        if "_events" in born.columns:  # consumer operators tell what they did: kept beside the population
            told = f"{folder}/born={state.generation}"
            born.write.mode("errorifexists").parquet(told)
            born = spark.read.parquet(told)
            _events(born, state.generation).write.mode("errorifexists").parquet(f"{folder}/events={state.generation}")
            born = born.drop("_events")
        seen = Observation(f"generation {state.generation}")
        rows = evaluate(born, problem).observe(seen, *_metrics())
        rows.write.mode("errorifexists").parquet(path)
        df = spark.read.parquet(path)
        if problem.schedule is not None:
            problem.schedule(ranking.wave_assignment(df.where("valid").select("population_index"), F.col("population_index"), config.workers))
        stats = _statistics(df, problem, config, seen.get)
        _commit(config, state, stats)
        if state.reason == "none" and problem.stop is not None and problem.stop(state.history[-1]):
            state.reason = "application"
        if problem.observer is not None:
            problem.observer(state.history[-1])
        body = asdict(state) | {"best_genome": state.best_genome.hex(), "config": {k: v for k, v in asdict(config).items() if k != "generation_limit"}}
        spark.createDataFrame([(json.dumps(body),)], "state string").write.mode("errorifexists").json(f"{folder}/state={state.generation}")
        if problem.storage is not None:
            problem.storage(ranking.storage_registry(spark.createDataFrame([(state.generation,)], "generation long")))
        if problem.checkpoint is not None:
            problem.checkpoint(path)
        if state.reason != "none":
            return state
        born = _next(df, config, state, stats["valid"], problem)
        state.generation += 1


def _events(born: DataFrame, generation: int) -> DataFrame:
    """Rows of the events that consumer operators told, numbered within each row of the population."""
    listed = born.select("population_index", F.posexplode(F.from_json("_events", "array<array<string>>")).alias("step", "e"))
    names = ("kind", "parent_a", "parent_b", "result", "status")
    return listed.select(F.lit(generation).cast("long").alias("generation"), "population_index", F.col("step").cast("long").alias("step"), *[F.get("e", F.lit(k)).alias(n) for k, n in enumerate(names)])


def recycle(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Deletes written generations but for the last `keep` (a resume needs the last); returns those that went."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("generation="))
    gone = numbers[: max(0, len(numbers) - keep)]
    for g in gone:
        for kind in ("generation", "born"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}={g}"), True)
    return gone


def popcount(genome: str, size: int) -> Column:
    """Number of set bits of a binary column of `size` bytes."""
    return F.expr(f"aggregate(sequence(1, {size}), 0, (s, i) -> s + bit_count(conv(hex(substring({genome}, i, 1)), 16, 10) + 0L))")
