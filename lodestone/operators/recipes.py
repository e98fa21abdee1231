"""Recipes as ordered lists of records: build order, operators on them, and repair.

A record is a dict with identity, target, transformation, version, parameters,
dependencies and conflicts.  A catalogue entry names a transformation with its
parameter schemas, dependencies and conflicts.  Recipes are small; many of them
are processed at once by applyInPandas over a recipe key.
"""

from __future__ import annotations

import heapq
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.fingerprint import fnv1a, fnv1a_text, text_form

from .ordered import total_rank

PHI64 = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
MUTATIONS = ("add", "remove", "parameterize", "replace", "reorder")


class RecipeError(ValueError):
    pass


def canonical_order(needs: dict[str, set[str]]) -> list[str]:
    """Dependency-first order that always takes the smallest ready identity; a cycle is an error."""
    waiting = {k: set(v) for k, v in needs.items()}
    ready = [k for k, v in waiting.items() if not v]
    heapq.heapify(ready)
    users: dict[str, list[str]] = {}
    for k, v in waiting.items():
        for d in v:
            if d not in waiting:
                raise RecipeError(f"missing dependency {d}")
            users.setdefault(d, []).append(k)
    out = []
    while ready:
        k = heapq.heappop(ready)
        out.append(k)
        for u in users.get(k, ()):
            waiting[u].discard(k)
            if not waiting[u]:
                heapq.heappush(ready, u)
    if len(out) < len(waiting):
        raise RecipeError("cycle")
    return out


def order_groups(edges: DataFrame, group: str) -> DataFrame:
    """edges(group, identity, dependency or null) -> (group, position, identity) of each group's canonical order.

    A group with a cycle or a missing dependency has one row, position -1, with the error as identity.
    A group is one recipe, whose record count its budget bounds.
    """

    def run(part):
        needs: dict[str, set[str]] = {i: set() for i in part["identity"]}
        for i, d in zip(part["identity"], part["dependency"]):
            if d is not None and d == d:
                needs[i].add(d)
        key = part[group].iloc[0]
        try:
            names = canonical_order(needs)
            return pd.DataFrame({group: key, "position": range(len(names)), "identity": names})
        except RecipeError as e:
            return pd.DataFrame({group: [key], "position": [-1], "identity": [str(e)]})

    return edges.groupBy(group).applyInPandas(run, f"{group} {dict(edges.dtypes)[group]}, position long, identity string")


def default_parameters(schemas: list[dict]) -> dict:
    """False, the minimum, or the first choice."""
    first = {"boolean": lambda s: False, "integer": lambda s: s["minimum"], "choice": lambda s: s["choices"][0]}
    return {s["name"]: first[s["kind"]](s) for s in schemas}


def bind_parameters(schemas: list[dict], values: dict) -> dict:
    """Values checked against their schemas: required ones present, kinds and ranges right, none unknown."""
    known = {s["name"]: s for s in schemas}
    for name in values:
        if name not in known:
            raise RecipeError(f"unknown parameter {name}")
    for name, s in known.items():
        if name not in values:
            if s.get("required", True):
                raise RecipeError(f"parameter {name} is missing")
            continue
        v = values[name]
        fits = {"boolean": lambda: isinstance(v, bool), "integer": lambda: isinstance(v, int) and not isinstance(v, bool) and s["minimum"] <= v <= s["maximum"], "choice": lambda: v in s["choices"]}  # noqa: B023
        if not fits[s["kind"]]():
            raise RecipeError(f"parameter {name} does not fit")
    return {name: values[name] for name in sorted(values)}


def duplicate(a: dict, b: dict) -> bool:
    return all(a[k] == b[k] for k in ("target", "transformation", "version"))


def reference(x) -> tuple[str, int]:
    """A catalogue reference as (transformation, version); a bare name means version 1."""
    return (x, 1) if isinstance(x, str) else (x[0], x[1])


def matches(need, record: dict) -> bool:
    return reference(need) == (record["transformation"], record["version"])


def conflict(a: dict, b: dict) -> bool:
    """Whether either of two records names the other, version included, among its conflicts."""
    return any(matches(x, b) for x in a.get("conflicts", ())) or any(matches(x, a) for x in b.get("conflicts", ()))


def compatible(recipe: list[dict], opportunities: list[dict], catalogue: list[dict]) -> list[dict]:
    """Records that could be added, by (opportunity rank, entry): the kind is allowed and none is there already."""
    out = []
    for o in sorted(opportunities, key=lambda o: o["rank"]):
        for e in catalogue:
            record = {"target": o["location"], "transformation": e["transformation"], "version": e["version"], "parameters": default_parameters(e.get("schemas", [])), "dependencies": e.get("dependencies", []), "conflicts": e.get("conflicts", [])}
            if e["mask"] & o["kind"] and not any(duplicate(record, r) for r in recipe):
                out.append(record)
    return out


def add(recipe, selector, opportunities, catalogue):
    pairs = compatible(recipe, opportunities, catalogue)
    if not pairs:
        raise RecipeError("nothing to add")
    return [*recipe, pairs[selector % len(pairs)]]


def remove(recipe, selector):
    if not recipe:
        raise RecipeError("empty recipe")
    k = selector % len(recipe)
    return recipe[:k] + recipe[k + 1 :]


def parameterize(recipe, selector, schemas_of, wrap: bool = True):
    """Changes one parameter, counted over all records: flips, adds one, next choice.

    At its maximum an integer goes back to its minimum, or without `wrap` one down.
    """
    places = [(i, s) for i, r in enumerate(recipe) for s in schemas_of(r)]
    if not places:
        raise RecipeError("no parameter")
    i, s = places[selector % len(places)]
    old = recipe[i]["parameters"][s["name"]]
    if s["kind"] == "boolean":
        new = not old
    elif s["kind"] == "integer":
        new = old + 1 if old < s["maximum"] else s["minimum"] if wrap else max(old - 1, s["minimum"])
    else:
        if len(s["choices"]) < 2:
            raise RecipeError("no other choice")
        new = s["choices"][(s["choices"].index(old) + 1) % len(s["choices"])]
    return [r if j != i else r | {"parameters": r["parameters"] | {s["name"]: new}} for j, r in enumerate(recipe)]


def replace(recipe, selector, opportunities, catalogue):
    """One record becomes another transformation at the same place; the k-th of all such (record, entry) pairs."""
    by_place = {o["location"]: o for o in opportunities}
    options = []
    for i, r in enumerate(recipe):
        here = [by_place[r["target"]]] if r["target"] in by_place else []
        options += [(i, x) for x in compatible(recipe[:i] + recipe[i + 1 :], here, catalogue) if not duplicate(x, r)]
    if not options:
        raise RecipeError("nothing to replace")
    i, x = options[selector % len(options)]
    return [*recipe[:i], x, *recipe[i + 1 :]]


def reorder(recipe, selector):
    """Swaps two different places."""
    n = len(recipe)
    if n < 2:
        raise RecipeError("too short")
    a = selector % n
    b = selector // n % (n - 1)
    b += b >= a
    out = list(recipe)
    out[a], out[b] = out[b], out[a]
    return out


def mutation_kind(selector: int, enabled: dict[str, bool]) -> str:
    kinds = [k for k in MUTATIONS if enabled.get(k)]
    if not kinds:
        raise RecipeError("no mutation is enabled")
    return kinds[selector % len(kinds)]


def cross(a: list, b: list, selector: int) -> tuple[list, list]:
    """Prefix of one and suffix of the other, both ways."""
    i, j = selector % (len(a) + 1), (selector >> 32) % (len(b) + 1)
    return a[:i] + b[j:], b[:j] + a[i:]


def spliced(df: DataFrame, key: str, a: str, b: str, selector: str) -> DataFrame:
    """(key, child_a, child_b): cross() of two list columns by a long selector, row by row."""
    types = dict(df.dtypes)

    def run(parts):
        for part in parts:
            out = [cross(list(x), list(y), int(s)) for x, y, s in zip(part[a], part[b], part[selector])]
            yield pd.DataFrame({key: part[key], "child_a": [x for x, _ in out], "child_b": [y for _, y in out]})

    return df.select(key, a, b, selector).mapInPandas(run, f"{key} {types[key]}, child_a {types[a]}, child_b {types[b]}")


def initialize(count: int, selector: int, opportunities, catalogue) -> list[dict]:
    recipe: list[dict] = []
    for i in range(count):
        recipe = add(recipe, (selector + PHI64 * (i + 1)) & _M64, opportunities, catalogue)
    return recipe


def repair(recipe: list[dict], opportunities: list[dict], catalogue: list[dict], passes: int = 8) -> list[dict]:
    """Until a pass changes nothing: later duplicates go, then later conflicting records; then each dependency must
    be met by exactly one record, and one without any is added where a single place allows it."""
    recipe = list(recipe)
    for _ in range(passes):
        kept: list[dict] = []
        for r in recipe:
            if not any(duplicate(r, k) for k in kept):
                kept.append(r)
        free: list[dict] = []
        for r in kept:
            if not any(conflict(r, k) for k in free):
                free.append(r)
        changed = len(free) != len(recipe)
        for r in free:  # records that are added have their own dependencies met too
            for need in r["dependencies"]:
                met = sum(matches(need, k) for k in free)
                if met > 1:
                    raise RecipeError(f"dependency {reference(need)[0]} is ambiguous")
                if met == 0:
                    ways = [x for x in compatible(free, opportunities, catalogue) if matches(need, x)]
                    if len(ways) != 1:
                        raise RecipeError(f"dependency {reference(need)[0]} is {'missing' if not ways else 'ambiguous'}")
                    free.append(ways[0])
                    changed = True
        if not changed:
            return named(free)
        recipe = free
    raise RecipeError("repair did not settle")


def named(recipe: list[dict]) -> list[dict]:
    return [r | {"identity": f"record-{i:06d}"} for i, r in enumerate(recipe)]


# --- genomes: canonical JSON in a fixed number of bytes

MAGIC, HEADER = b"RECIPE01", 16


def canonical_json(recipe: list[dict]) -> bytes:
    """Records in order, keys sorted, no blanks: one recipe has one form."""
    return json.dumps(recipe, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def to_genome(recipe: list[dict], size: int) -> bytes:
    """Magic, payload size (8 bytes, little-endian), payload, zeros; a byte is left free after the payload."""
    payload = canonical_json(recipe)
    if HEADER + len(payload) >= size:
        raise RecipeError("resource-limit")
    return (MAGIC + len(payload).to_bytes(8, "little") + payload).ljust(size, b"\0")


def from_genome(genome: bytes) -> list[dict]:
    """The recipe of a genome in canonical form; anything else is an error."""
    size = int.from_bytes(genome[8:HEADER], "little")
    if genome[:8] != MAGIC or not 0 < size < len(genome) - HEADER or any(genome[HEADER + size :]):
        raise RecipeError("genome")
    try:
        recipe = json.loads(genome[HEADER : HEADER + size])
    except ValueError:
        raise RecipeError("genome") from None
    if not isinstance(recipe, list) or to_genome(recipe, len(genome)) != genome:
        raise RecipeError("genome-noncanonical")
    return recipe


def recipe_fingerprint(recipe: list[dict]) -> str:
    return text_form(fnv1a(canonical_json(recipe)))


def genome_column(payload: Column, size: int) -> Column:
    """to_genome() of a column of canonical JSON text; null where it does not fit."""
    from lodestone.functions.canonical import number

    raw = F.encode(payload, "utf-8")
    fits = F.octet_length(raw) + HEADER < size
    zeros = F.unhex(F.repeat(F.lit("00"), size - HEADER - F.octet_length(raw)))
    return F.when(fits, F.concat(F.lit(MAGIC), number(F.octet_length(raw)), raw, zeros))


def payload_column(genome: Column) -> Column:
    """The canonical JSON text of a column of genomes; null for another header, a bad size, or bytes after the payload."""
    digits = F.hex(F.substring(genome, 9, 8))
    size = F.conv(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]), 16, 10).try_cast("long")
    fine = (F.substring(genome, 1, 8) == F.lit(MAGIC)) & (size > 0) & (size < F.octet_length(genome) - HEADER)
    rest = F.hex(genome.substr((size + HEADER + 1).cast("int"), F.octet_length(genome)))
    return F.when(fine & ~F.coalesce(rest.rlike("[1-9A-F]"), F.lit(True)), genome.substr(F.lit(HEADER + 1), size.cast("int")).cast("string"))


def fingerprint_column(payload: Column) -> Column:
    return fnv1a_text(payload)


# --- recipes of proposals, as joins

def catalogue_problems(entries: DataFrame, kinds_mask: int) -> DataFrame:
    """(transformation, version, problem) of catalogue entries that break a rule, the first one each.

    entries(position, transformation, version, mask, dependencies and conflicts:
    array<struct<transformation, version>>): versions and masks are positive,
    masks within kinds_mask, entries sorted and unique, references name other
    entries of the catalogue, and none is both needed and refused.
    """
    name = F.struct("transformation", "version")
    placed = total_rank(entries, [F.col("position")], "_at")
    before = placed.select((F.col("_at") + 1).alias("_at"), name.alias("_before"))
    rows = placed.join(before, "_at", "left").withColumn("_all", F.concat("dependencies", "conflicts"))
    known = entries.select(F.col("transformation").alias("_t"), F.col("version").alias("_v")).distinct()
    wanted = rows.select("position", F.explode("_all").alias("r"))
    lost = wanted.join(known, (F.col("r.transformation") == F.col("_t")) & (F.col("r.version") == F.col("_v")), "left_anti").select("position").distinct().withColumn("_lost", F.lit(True))
    rows = rows.join(lost, "position", "left")
    problem = (
        F.when(~F.coalesce((F.length("transformation") > 0) & (F.col("version") > 0), F.lit(False)), "identity")
        .when(~F.coalesce((F.col("mask") != 0) & (F.col("mask").bitwiseAND(F.lit(~kinds_mask)) == 0), F.lit(False)), "location-kinds")
        .when(F.coalesce(F.col("_before") >= name, F.lit(False)), "order")
        .when(F.exists("_all", lambda r: (r["transformation"] == F.col("transformation")) & (r["version"] == F.col("version"))), "refers-to-itself")
        .when(F.coalesce("_lost", F.lit(False)), "unknown-reference")
        .when(F.size(F.array_intersect("dependencies", "conflicts")) > 0, "needed-and-refused")
    )
    return rows.select("transformation", "version", problem.alias("problem")).where("problem is not null")


def default_values(schemas: DataFrame) -> DataFrame:
    """(transformation, version, name, kind, boolean_value, integer_value, choice_value): false, the minimum, or the first
    choice, for each schema row of parameter_problems()."""
    kind = F.col("kind")
    return schemas.select(
        "transformation", "version", "name", "kind", F.when(kind == "boolean", False).alias("boolean_value"), F.when(kind == "integer", F.col("minimum")).alias("integer_value"),
        F.when(kind == "choice", F.get("choices", F.lit(0))).alias("choice_value"),
    )


def parameter_problems(records: DataFrame, values: DataFrame, schemas: DataFrame) -> DataFrame:
    """(recipe, identity, parameter, problem): the first parameter by name, of each record, that does not bind.

    records(recipe, identity, transformation, version); values(recipe, identity,
    name, kind, boolean_value, integer_value, choice_value) are what proposals
    give; schemas(transformation, version, name, kind, required, minimum,
    maximum, choices).  A value is 'unknown' without a schema, 'repeated' if its
    record gives it twice, of the wrong 'kind', out of 'range' or none of the
    schema's choices ('choice'); a required parameter without value is 'missing'.
    Records meet their values by key and the small catalogue by transformation.
    """
    own = records.select("recipe", "identity", "transformation", "version").distinct()
    s = schemas.select(F.col("transformation").alias("_t"), F.col("version").alias("_v"), F.col("name").alias("_n"), F.col("kind").alias("_k"), "required", "minimum", "maximum", "choices")
    given = values.groupBy("recipe", "identity", "name").agg(F.count(F.lit(1)).alias("_times"), F.min_by(F.struct("kind", "boolean_value", "integer_value", "choice_value"), "kind").alias("_value"))
    of = (F.col("transformation") == F.col("_t")) & (F.col("version") == F.col("_v"))
    met = given.join(own, ["recipe", "identity"]).join(s, of & (F.col("name") == F.col("_n")), "left")
    v = lambda c: F.col(f"_value.{c}")
    fits = F.when(F.col("_k") == "boolean", v("boolean_value").isNotNull()).when(F.col("_k") == "integer", v("integer_value").isNotNull()).when(F.col("_k") == "choice", v("choice_value").isNotNull())
    problem = (
        F.when(F.col("_n").isNull(), "unknown")
        .when(F.col("_times") > 1, "repeated")
        .when(~F.coalesce((v("kind") == F.col("_k")) & fits, F.lit(False)), "kind")
        .when((F.col("_k") == "integer") & ~F.coalesce(v("integer_value").between(F.col("minimum"), F.col("maximum")), F.lit(False)), "range")
        .when((F.col("_k") == "choice") & ~F.coalesce(F.array_contains("choices", v("choice_value")), F.lit(False)), "choice")
    )
    bad = met.select("recipe", "identity", F.col("name").alias("parameter"), problem.alias("problem")).where("problem is not null")
    wanted = own.join(s.where("required"), of).select("recipe", "identity", F.col("_n").alias("parameter"))
    there = given.select("recipe", "identity", F.col("name").alias("parameter"))
    missing = wanted.join(there, ["recipe", "identity", "parameter"], "left_anti").withColumn("problem", F.lit("missing"))
    first = bad.unionByName(missing).groupBy("recipe", "identity").agg(F.min(F.struct("parameter", "problem")).alias("_p"))
    return first.select("recipe", "identity", "_p.parameter", "_p.problem")


def build_records(proposals: DataFrame, catalogue: DataFrame, locations: DataFrame, opportunities: DataFrame, missed: DataFrame, runtime: DataFrame, kind_bits: dict[str, int]) -> DataFrame:
    """One row per proposal with what its record holds and its status: 'ok' or the first reason that refuses it.

    proposals(recipe, identity, target, transformation, version);
    catalogue(transformation, version, mask, dependencies, conflicts);
    locations(identity, file, kind, ...); opportunities(location, rank,
    missed_optimization_count, runtime_evidence_present); missed(location,
    identity) and runtime(location, identity) are the evidence records.  Reasons
    in order: recipe-invalid, unknown-transformation, stale-target,
    analysis-stale, dependency-missing, dependency-ambiguous, conflict.
    """
    entry = catalogue.select(F.col("transformation").alias("_t"), F.col("version").alias("_v"), F.col("mask").alias("_mask"), F.col("dependencies").alias("_needs"), F.col("conflicts").alias("_clashes"))
    place = locations.select(F.col("identity").alias("_place"), "file", F.col("kind").alias("location_kind"))
    chance = opportunities.select(F.col("location").alias("_chance"), F.col("rank").alias("opportunity_rank"), F.col("missed_optimization_count").alias("_missed"), F.col("runtime_evidence_present").alias("_present"))
    gather = lambda df, name: df.groupBy(F.col("location").alias(f"_{name}_at")).agg(F.sort_array(F.collect_list("identity")).alias(name))  # noqa: E731  one place's evidence, which budgets bound
    compiler, samples = gather(missed, "compiler_records"), gather(runtime, "runtime_records")
    rows = proposals.join(entry, (F.col("transformation") == F.col("_t")) & (F.col("version") == F.col("_v")), "left")
    rows = rows.join(place, F.col("target") == F.col("_place"), "left").join(chance, F.col("target") == F.col("_chance"), "left")
    rows = rows.join(compiler, F.col("target") == F.col("_compiler_records_at"), "left").join(samples, F.col("target") == F.col("_runtime_records_at"), "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("compiler_records", F.coalesce("compiler_records", none)).withColumn("runtime_records", F.coalesce("runtime_records", none))
    # How many records of the recipe meet each need and each clash.
    here = proposals.groupBy("recipe", F.col("transformation").alias("_ht"), F.col("version").alias("_hv")).agg(F.count(F.lit(1)).alias("_have"), F.min("identity").alias("_one"))

    def met(column: str, name: str) -> DataFrame:
        asked = rows.select("recipe", "identity", F.explode(column).alias("r"))
        hits = asked.join(here, (asked.recipe == here.recipe) & (F.col("r.transformation") == F.col("_ht")) & (F.col("r.version") == F.col("_hv")), "left").select(asked.recipe, "identity", "r", F.coalesce("_have", F.lit(0)).alias("n"), "_one")
        record = F.struct("_one", "r.transformation", "r.version")
        return hits.groupBy("recipe", "identity").agg(F.min("n").alias(f"{name}_least"), F.max("n").alias(f"{name}_most"), F.sort_array(F.collect_list(record)).alias(f"{name}_records"))

    rows = rows.join(met("_needs", "_need"), ["recipe", "identity"], "left").join(met("_clashes", "_clash"), ["recipe", "identity"], "left")
    twice = proposals.groupBy("recipe", "identity").agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.join(twice, ["recipe", "identity"])
    bit = F.lit(0).cast("long")
    for kind, value in kind_bits.items():
        bit = F.when(F.col("location_kind") == kind, F.lit(value).cast("long")).otherwise(bit)
    named_ = (F.length("identity") > 0) & (F.length("target") > 0) & (F.length("transformation") > 0) & (F.col("version") > 0) & (F.col("_copies") == 1)
    status = (
        F.when(~F.coalesce(named_, F.lit(False)), "recipe-invalid")
        .when(F.col("_t").isNull(), "unknown-transformation")
        .when(F.col("_place").isNull() | F.col("_chance").isNull() | (F.col("_mask").cast("long").bitwiseAND(bit) == 0), "stale-target")
        .when((F.size("compiler_records") != F.col("_missed")) | ((F.size("runtime_records") > 0) != F.col("_present")), "analysis-stale")
        .when(F.coalesce(F.col("_need_least") == 0, F.lit(False)), "dependency-missing")
        .when(F.coalesce(F.col("_need_most") > 1, F.lit(False)), "dependency-ambiguous")
        .when(F.coalesce(F.col("_clash_most") > 0, F.lit(False)), "conflict")
        .otherwise("ok")
    )
    needs = F.coalesce(F.transform("_need_records", lambda x: x["_one"]), none)
    return rows.select("recipe", "identity", "target", "transformation", "version", "file", "location_kind", "opportunity_rank", "compiler_records", "runtime_records", needs.alias("dependency_records"), status.alias("status"))


def ordered_records(records: DataFrame) -> DataFrame:
    """(recipe, position, identity) of recipes all of whose records are 'ok', in canonical order; position -1 for a cycle."""
    broken = records.where("status <> 'ok'").select("recipe").distinct()
    fine = records.join(broken, "recipe", "left_anti")
    edges = fine.select("recipe", "identity", F.explode_outer("dependency_records").alias("dependency"))
    return order_groups(edges, "recipe")
