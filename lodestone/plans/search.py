"""Search over transformation recipes: the generation loop with recipe operators and recorded outcomes.

Genomes are recipes in canonical JSON (operators.recipes).  Every operation is a
function of its genomes and of its place (generation, slot, step), so rows are
independent and run in any order.  A recipe that an operation cannot make whole
becomes a zero genome, which no recipe has: it is invalid from then on.

The run leaves three tables: the populations (plans.run), operator events, and
lineage rows that say where each candidate came from and how it was judged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.fingerprint import fnv1a, fnv1a_number, fnv1a_string
from lodestone.operators import assurance, integrity, recipes
from lodestone.operators.identity import TAGS
from lodestone.plans import run as core

EVENTS = "generation long, population_index long, step long, kind string, parent_a string, parent_b string, result string, status string"
_EVENT_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
#: Outcomes of a recorded evaluation, by recipe fingerprint.
OUTCOME = "recipe string, accepted boolean, correct boolean, eligible boolean, measured boolean, total double"


@dataclass(frozen=True)
class Space:
    """What recipes are made of, and how they change."""

    opportunities: tuple[dict, ...]
    catalogue: tuple[dict, ...]
    identity: str = "search"
    initial_records: int = 2
    max_mutations: int = 2
    enabled: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(recipes.MUTATIONS, True))
    repair_passes: int = 8
    wrap: bool = True

    def schemas(self, record: dict) -> list[dict]:
        return next((e.get("schemas", []) for e in self.catalogue if recipes.matches((e["transformation"], e["version"]), record)), [])


def selector(space: Space, seed: int, domain: str, ordinal: int, *genomes: bytes) -> int:
    """The number that an operation's choices are taken from."""
    value = fnv1a_string(space.identity, fnv1a_number(ordinal, fnv1a_number(seed, fnv1a_string(domain, fnv1a_string(TAGS["selector"])))))
    for g in genomes:
        value = fnv1a(g, value)
    return value


def _whole(space: Space, recipe: list[dict], size: int) -> tuple[bytes, str]:
    fixed = recipes.repair(recipe, space.opportunities, space.catalogue, space.repair_passes)
    return recipes.to_genome(fixed, size), recipes.recipe_fingerprint(fixed)


def _status(error: recipes.RecipeError) -> str:
    return "resource-limit" if "resource-limit" in str(error) else "recipe-invalid"


def _ordinal(generation: int, slot: int) -> int:
    return generation << 32 | slot


def start(space: Space, seed: int, slot: int, genome: bytes) -> tuple[bytes, list[tuple]]:
    """The first recipe of a slot from its seeded bytes."""
    try:
        made = recipes.initialize(space.initial_records, selector(space, seed, "initialize", _ordinal(0, slot), genome), space.opportunities, space.catalogue)
        out, name = _whole(space, made, len(genome))
        return out, [("initialize", None, None, name, "ok")]
    except recipes.RecipeError as e:
        return bytes(len(genome)), [("initialize", None, None, None, _status(e))]


def _decoded(genome: bytes) -> tuple[list[dict] | None, str | None]:
    try:
        recipe = recipes.from_genome(genome)
        return recipe, recipes.recipe_fingerprint(recipe)
    except recipes.RecipeError:
        return None, None


def crossed(space: Space, seed: int, generation: int, pair: int, a: bytes, b: bytes) -> tuple[bytes, bytes, list[tuple], list[tuple]]:
    """Both children of two parents and their events; where any part fails both are zero."""
    (one, name_a), (two, name_b) = _decoded(a), _decoded(b)
    status = "recipe-invalid"
    if one is not None and two is not None:
        try:
            x, y = recipes.cross(one, two, selector(space, seed, "crossover", _ordinal(generation, pair), a, b))
            (first, f), (second, s) = _whole(space, x, len(a)), _whole(space, y, len(b))
            return first, second, [("crossover", name_a, name_b, f, "ok")], [("crossover", name_b, name_a, s, "ok")]
        except recipes.RecipeError as e:
            status = _status(e)
    return bytes(len(a)), bytes(len(b)), [("crossover", name_a, name_b, None, status)], [("crossover", name_b, name_a, None, status)]


def mutated(space: Space, seed: int, generation: int, slot: int, rate: float, genome: bytes) -> tuple[bytes, list[tuple]]:
    """One to max_mutations operations, each on the result of the one before; a failure makes the genome zero."""
    recipe, name = _decoded(genome)
    if recipe is None:
        return bytes(len(genome)), [("add", None, None, None, "recipe-invalid")]
    choice = selector(space, seed, format(rate, ".17g"), _ordinal(generation, slot), genome)
    events: list[tuple] = []
    for k in range(1 + choice % space.max_mutations):
        own = (choice + recipes.PHI64 * (k + 1)) & (1 << 64) - 1
        kind = recipes.mutation_kind(own, space.enabled)
        try:
            changed = {
                "add": lambda: recipes.add(recipe, own, space.opportunities, space.catalogue),
                "remove": lambda: recipes.remove(recipe, own),
                "parameterize": lambda: recipes.parameterize(recipe, own, space.schemas, space.wrap),
                "replace": lambda: recipes.replace(recipe, own, space.opportunities, space.catalogue),
                "reorder": lambda: recipes.reorder(recipe, own),
            }[kind]()
            genome, result = _whole(space, changed, len(genome))
        except recipes.RecipeError as e:
            return bytes(len(genome)), [*events, (kind, name, None, None, _status(e))]
        events.append((kind, name, None, result, "ok"))
        recipe, name = recipes.from_genome(genome), result
    return genome, events


def hooks(space: Space, seed: int) -> dict[str, Callable]:
    """The consumer operators of plans.run.Problem, by name."""
    return {
        "initialize": lambda slot, genome: start(space, seed, slot, genome),
        "cross": lambda generation, pair, a, b: crossed(space, seed, generation, pair, a, b),
        "mutate": lambda generation, slot, rate, genome: mutated(space, seed, generation, slot, rate, genome),
    }


def decoded(df: DataFrame) -> DataFrame:
    """Adds recipe: the fingerprint of each genome's recipe, null where it holds none."""

    def run(parts):
        for part in parts:
            yield part.assign(recipe=[_decoded(bytes(g))[1] for g in part["genome"]])

    return df.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", recipe string")


def judged(df: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds recipe, rejection, valid and total from the outcomes (OUTCOME) recorded for each recipe.

    A genome without a recipe is 'recipe-invalid'; a recipe without an outcome
    counts as refused by the provider.
    """
    said = outcomes.select(F.col("recipe").alias("_recipe"), "accepted", "correct", "eligible", "measured", F.col("total").alias("_total"))
    rows = decoded(df).join(said, F.col("recipe") == F.col("_recipe"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    reason = assurance.rejection(flag(F.col("accepted")), flag(F.col("correct")), flag(F.col("eligible")), flag(F.col("measured")))
    rows = rows.withColumn("rejection", F.when(F.col("recipe").isNull(), "recipe-invalid").otherwise(reason)).withColumn("valid", F.col("rejection") == "none")
    return rows.withColumn("total", F.when(F.col("valid"), F.col("_total")).otherwise(0.0)).select(*df.columns, "recipe", "rejection", "valid", "total")


@dataclass
class Result:
    state: core.State
    events: DataFrame
    lineage: DataFrame
    winner: DataFrame


def lineage_rows(populations: DataFrame, events: DataFrame) -> DataFrame:
    """One row per candidate: its judgement, the first event's parents, the last event's kind, and how many there were.

    A candidate without an event is a clone of its own recipe.
    """
    bound = integrity.bind_first(events.withColumn("ordinal", F.col("step")), ["generation", "population_index"], "ordinal", "kind", ["parent_a", "parent_b"])
    rows = populations.join(bound, ["generation", "population_index"], "left")
    clone = F.col("last_kind").isNull()
    return rows.select(
        "generation", "population_index", "recipe", "valid", "total", "rejection", F.coalesce("last_kind", F.lit("clone")).alias("operator"),
        F.when(clone, F.col("recipe")).otherwise(F.col("parent_a")).alias("parent_a"), "parent_b", F.coalesce("events", F.lit(1)).cast("long").alias("events"),
    )


def winner_of(lineage: DataFrame) -> DataFrame:
    """The first valid row, in order, with the best total."""
    return integrity.winner_row(lineage.where("valid"), ["generation", "population_index"], "total")


def run(spark: SparkSession, space: Space, config: core.Config, outcomes: Callable[[DataFrame], DataFrame], folder: str) -> Result:
    """Search from the seeded population on.

    outcomes: DataFrame of recipes (recipe, genome) -> rows of OUTCOME; recorded
    evaluations are a join, live ones any DataFrame function.
    """

    def evaluate(df: DataFrame) -> DataFrame:
        asked = decoded(df).where("recipe is not null").select("recipe", "genome").dropDuplicates(["recipe"])
        return judged(df, outcomes(asked))

    own = hooks(space, config.seed)
    problem = core.Problem(evaluate=evaluate, initialize=own["initialize"], cross=own["cross"], mutate=own["mutate"])
    state = core.run(spark, problem, replace(config, crossover="consumer", mutation="consumer"), folder)
    generations = range(state.generation + 1)
    populations = None
    events = spark.createDataFrame([], EVENTS)
    for g in generations:  # as many as the configuration allows
        rows = spark.read.parquet(f"{folder}/generation={g}").withColumn("generation", F.lit(g).cast("long"))
        populations = rows if populations is None else populations.unionByName(rows)
        events = events.unionByName(spark.read.schema(EVENTS).parquet(f"{folder}/events={g}"))
    lineage = lineage_rows(populations, events)
    return Result(state, events, lineage, winner_of(lineage))


def event_rows(generation: int, slot: int, events: list[tuple]) -> list[tuple]:
    return [(generation, slot, step, *e) for step, e in enumerate(events)]


def event_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_EVENT_NAMES)
