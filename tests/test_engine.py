"""Stages, snapshots, documents, searches and streams end to end on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analysis, folds, measurement, ranking, recipes, rewrites
from lodestone.plans import run as core
from lodestone.plans import search, stages
from lodestone.sources import documents, product, recorded
from lodestone.streaming import observer

CATALOGUE = (
    {"transformation": "t1", "version": 1, "mask": 1, "schemas": [{"name": "k", "kind": "integer", "minimum": 1, "maximum": 3}], "dependencies": [("t2", 1)]},
    {"transformation": "t2", "version": 1, "mask": 2},
    {"transformation": "t3", "version": 1, "mask": 3, "conflicts": [("t2", 2)]},
)
PLACES = tuple({"rank": i, "location": f"l{i}", "kind": 2 if i == 2 else 1} for i in range(1, 7))
SPACE = search.Space(PLACES, CATALOGUE)


def outcomes(asked):
    mark = F.crc32("recipe")
    return asked.select("recipe", F.lit(True).alias("accepted"), F.lit(True).alias("correct"), (mark % 7 != 0).alias("eligible"), F.lit(True).alias("measured"), (mark % 100).cast("double").alias("total"))


def test_search_run(spark, tmp_path):
    config = core.Config(8, 1024, 2, 7, mutation_rate=0.6)
    one = search.run(spark, SPACE, config, outcomes, f"{tmp_path}/a")
    two = search.run(spark, SPACE, config, outcomes, f"{tmp_path}/b")
    rows = sorted(tuple(r) for r in one.lineage.collect())
    assert rows == sorted(tuple(r) for r in two.lineage.collect()) and len(rows) == 24
    best = one.winner.first()
    assert best["total"] == one.state.best_total == max(r["total"] for r in one.lineage.where("valid").collect())
    assert {r["kind"] for r in one.events.collect()} >= {"initialize"}
    # A candidate's last event names its recipe, a failed one none.
    last = {(r["generation"], r["population_index"]): r for r in one.events.orderBy("step").collect()}
    for r in one.lineage.collect():
        if r["operator"] != "clone":
            assert last[r["generation"], r["population_index"]]["result"] == r["recipe"]


def test_mutation_of_what_is_no_recipe():
    zero = bytes(256)
    assert search.mutated(SPACE, 1, 1, 0, 0.5, zero) == (zero, [("add", None, None, None, "recipe-invalid")])
    a, b, first, second = search.crossed(SPACE, 1, 1, 0, zero, zero)
    assert a == b == zero and first[0][4] == second[0][4] == "recipe-invalid"


def test_genomes_are_canonical():
    recipe = recipes.named(recipes.add([], 0, PLACES, CATALOGUE))
    genome = recipes.to_genome(recipe, 512)
    assert recipes.canonical_json(recipes.from_genome(genome)) == recipes.canonical_json(recipe)
    for bad in (genome[:-1] + b"x", b"x" + genome[1:], genome.replace(b'"k":1', b'"k": 1')[:512]):
        with pytest.raises(recipes.RecipeError):
            recipes.from_genome(bad)
    with pytest.raises(recipes.RecipeError):
        recipes.to_genome(recipe, 32)


def test_parameters_without_wrapping():
    schemas = lambda r: CATALOGUE[0]["schemas"]
    top = [{"target": "l1", "transformation": "t1", "version": 1, "parameters": {"k": 3}}]
    assert recipes.parameterize(top, 0, schemas, wrap=False)[0]["parameters"]["k"] == 2
    assert recipes.parameterize(top, 0, schemas)[0]["parameters"]["k"] == 1


def test_repair_is_strict_about_dependencies():
    need = {"target": "l1", "transformation": "t1", "version": 1, "parameters": {"k": 1}, "dependencies": [("t2", 1)], "conflicts": []}
    met = [{"target": f"l{i}", "transformation": "t2", "version": 1, "parameters": {}, "dependencies": [], "conflicts": []} for i in (2, 9)]
    with pytest.raises(recipes.RecipeError, match="ambiguous"):
        recipes.repair([need, *met], PLACES, CATALOGUE)
    other = [met[0] | {"version": 2}]
    assert [(r["transformation"], r["version"]) for r in recipes.repair([need, *other], PLACES, CATALOGUE)] == [("t1", 1), ("t2", 2), ("t2", 1)]


def test_replacement_stays_at_its_place():
    one = recipes.add([], 0, PLACES, CATALOGUE)
    other = recipes.replace(one, 0, PLACES, CATALOGUE)
    assert other[0]["target"] == one[0]["target"] and other[0]["transformation"] != one[0]["transformation"]


def test_hooks_of_a_run(spark, tmp_path):
    seen = {"storage": [], "schedule": [], "checkpoint": []}
    problem = core.Problem(
        fitness=core.popcount("genome", 2), distance=lambda a, b: F.when(F.col(f"{a}.genome") == F.col(f"{b}.genome"), 0.0).otherwise(1.0),
        initialize=lambda slot, genome: (bytes([slot, 255]), [("initialize", None, None, None, "ok")]),
        storage=lambda df: seen["storage"].append(df.first()["active_owner"]), schedule=lambda df: seen["schedule"].append(df.count()), checkpoint=lambda p: seen["checkpoint"].append(p),
    )
    state = core.run(spark, problem, core.Config(4, 2, 1, 3, diversity_budget=100), str(tmp_path))
    assert seen["storage"] == [1, 2] and seen["schedule"] == [4, 4] and len(seen["checkpoint"]) == 2
    assert state.history[0]["diversity"] == 1.0 and core.recycle(spark, str(tmp_path), keep=1) == [0]
    with pytest.raises(ValueError):
        core.run(spark, problem, core.Config(9, 2, 1, 3, diversity_budget=5), f"{tmp_path}/x")


def test_snapshot(spark, tmp_path):
    files = spark.createDataFrame([("a.c", b"one"), ("b/c.c", b"two")], "path string, content binary")
    recorded.prepare_snapshot(files, f"{tmp_path}/p", 5, 10, 20)
    recorded.commit_snapshot(spark, f"{tmp_path}/p", f"{tmp_path}/s")
    asked = spark.createDataFrame([("a.c",), ("x.c",)], "path string")
    got = {r["path"]: (r["content"], r["problem"]) for r in recorded.snapshot_files(spark, f"{tmp_path}/s", asked, 10).collect()}
    assert bytes(got["a.c"][0]) == b"one" and got["x.c"] == (None, "missing")
    assert recorded.byte_differences(files, files.withColumn("content", F.when(F.col("path") == "a.c", F.encode(F.lit("new"), "utf-8")).otherwise(F.col("content")))).collect()[0]["state"] == "changed"
    for bad, why in (([("../x", b"")], "path"), ([("a", b""), ("a", b"")], "repeated"), ([("a", b"0123456789abc")], "file size")):
        with pytest.raises(ValueError, match=why):
            recorded.prepare_snapshot(spark.createDataFrame(bad, "path string, content binary"), f"{tmp_path}/bad", 5, 10, 20)
    with pytest.raises(ValueError):
        recorded.commit_snapshot(spark, f"{tmp_path}/s", f"{tmp_path}/s")


def test_baseline_and_analysis(spark, tmp_path):
    projects = spark.createDataFrame([("p", "m", 1, 2, "prov", True)], "subject string, manifest_id string, manifest_fingerprint long, build_fingerprint long, provider string, benchmark_required boolean")
    files = spark.createDataFrame([("p", "a.c", 420, b"int x;")], "subject string, path string, mode long, content binary")
    told = spark.createDataFrame([("p", s, False, 0, 3, 9) for s in recorded.STAGES], recorded.OUTCOME)
    stage = stages.capture_baseline(projects, files, told)
    assert stage.results.first()["state"] == "eligible"
    said = json.loads(stage.evidence.first()["json"])
    assert [c["stage"] for c in said["commands"]] == list(recorded.STAGES) and said["files"][0]["path"] == "a.c"
    documents.publish(stage.evidence, f"{tmp_path}/evidence")
    with pytest.raises(FileExistsError):
        documents.publish(stage.evidence, f"{tmp_path}/evidence")

    rows = {
        "source_locations": [("l1", "a.c", 1, 1, 1, 3, "spelling", None), ("l2", "a.c", 2, 1, 2, 3, "macro-expansion", "l1")], "declarations": [("f", "f", "a.c", "l1", "function", "external", True)],
        "calls": [("c1", "f", "f", "l1", "direct")], "optimizations": [("o1", "inline", "f", "l2", "no", "missed")], "runtime_records": [("r1", "w", "f", "l1", "sample-count", 9)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, recorded.ANALYSIS_TABLES[name]).write.json(f"{tmp_path}/analysis/{name}")
    tables = recorded.read_analysis(spark, f"{tmp_path}/analysis")
    head = spark.createDataFrame([("k", "b", "p", "c", "l", "t", "f", 1, None)], "key string, baseline_fingerprint string, provider string, compiler string, backend string, target string, flags string, runtime_state long, runtime_profile string")
    units, loads = spark.createDataFrame([("a.c",)], "file string"), spark.createDataFrame([("w",)], "workload string")
    kinds = {"source_locations": {"kind": {"spelling": 1, "macro-expansion": 2}}, "declarations": {"kind": {"function": 1}, "linkage": {"external": 3}}, "calls": {"kind": {"direct": 1}}, "optimizations": {"disposition": {"missed": 2}}, "runtime_records": {"metric": {"sample-count": 1}}}
    out = stages.analyze(tables, head, files.select("path"), units, loads, kinds)
    assert [(r["location"], r["rank"]) for r in out.results.collect()] == [("l1", 1), ("l2", 2)]
    assert out.fingerprints.first()["fingerprint"].startswith("fnv1a64-v1:")
    model = analysis.build(tables, files.select("path"), units, loads.limit(0))
    with pytest.raises(ValueError, match="workload"):
        model.check()
    with pytest.raises(ValueError, match="limit"):
        model.check({"calls": 0})
    with pytest.raises(ValueError):
        recorded.read_analysis(spark, f"{tmp_path}/nothing")


def _node(kind, a, b, **more):
    return {"kind": kind, "range": {"begin": {"offset": a, "tokLen": 1}, "end": {"offset": b - 1, "tokLen": 1}}, **more}


def _name(a, b, identity, type_="int"):
    return _node("DeclRefExpr", a, b, referencedDecl={"id": identity, "name": "v", "type": {"qualType": type_}})


def _assignment(other="0x1", type_="int"):
    right = _node("BinaryOperator", 4, 13, opcode="-", type={"qualType": "int"}, inner=[_name(4, 5, other)])
    return {"kind": "Top", "inner": [_node("BinaryOperator", 0, 13, opcode="=", type={"qualType": type_}, inner=[_name(0, 1, "0x1"), right])]}


@pytest.mark.parametrize(
    "source, end, tree, status",
    [
        ("n = n - (a-b)", 13, _assignment(), "edit"), ("n = n - (a-b)", 13, _assignment("0x2"), "not-applicable"), ("n = n - (a-b)", 13, _assignment(type_="long"), "not-applicable"),
        ("n = m - (a-b)", 13, _assignment(), "not-applicable"), ("n = n - a - b", 13, {"kind": "Top", "inner": _assignment()["inner"] * 2}, "ambiguous-target"),
        ("n = n - (a-b)", 40, _assignment(), "facts-malformed"), ("n = n - (a-b)", 13, {"kind": "Top"}, "not-applicable"),
    ],
)
def test_assignments_need_their_tree(spark, source, end, tree, status):
    rows = spark.createDataFrame([(source, rewrites.ASSIGNMENT, "subtract", "spelling", 0, end, json.dumps(tree))], "source string, transformation string, parameter string, location_kind string, target_start long, target_end long, tree string")
    row = rewrites.rewrites(rewrites.tree_facts(rows)).first()
    assert status in (row["status"], row["facts_status"]) and (row["replacement"] == "n -= (a-b)") == (status == "edit")


def test_a_negation_of_one_side_is_no_double_negation(spark):
    inner = _node("BinaryOperator", 4, 12, opcode="==", inner=[_node("UnaryOperator", 4, 7, opcode="!", inner=[_node("UnaryOperator", 5, 7, opcode="!")])])
    macro = _node("UnaryOperator", 4, 7, opcode="!", inner=[{**_node("UnaryOperator", 5, 7, opcode="!"), "range": {"begin": {"expansionLoc": {"offset": 5, "tokLen": 1}}, "end": {"offset": 6, "tokLen": 1}}}])
    rows = [(source, rewrites.CONDITION, 4, end, json.dumps({"kind": "Top", "inner": [_node("IfStmt", 0, 16, inner=[x])]})) for source, end, x in (("if (!!a == b) x;", 12, inner), ("if (!!a) x;", 7, macro))]
    one, two = rewrites.tree_facts(spark.createDataFrame(rows, "source string, transformation string, target_start long, target_end long, tree string")).orderBy(F.desc("target_end")).collect()
    assert one["facts_status"] == "not-applicable" and two["facts_status"] == "found" and two["contains_macro"]


def test_product_checkpoint_refuses_damage():
    identity = dict.fromkeys(product.VERSIONS, 1) | {"seed": 2**63, "generation": 4} | dict.fromkeys(product.TEXTS, "é")
    raw = product.create(identity, b"inner")
    assert product.parse(raw)[:2] == (identity, b"inner")
    for k in range(len(raw)):
        with pytest.raises(product.ProductError):
            product.parse(raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :])
    with pytest.raises(product.ProductError):
        product.create(identity | {"toolchain": ""}, b"inner")


def test_streams(spark, tmp_path):
    """Micro-batches of a trace, and windows with a watermark, give what the batch gives."""
    schema = "ts timestamp, kind string, total double"
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:04:00", "a", 5.0), ("2024-01-01 00:06:00", "b", 2.0)], "ts string, kind string, total double").select(F.col("ts").cast("timestamp").alias("ts"), "kind", "total")
    rows.write.parquet(f"{tmp_path}/in")
    stream = observer.read_trace(spark, f"{tmp_path}/in", schema)
    seen = []
    observer.observe(stream, lambda batch, number: seen.append((number, batch.count())), f"{tmp_path}/o").awaitTermination(120)
    assert sum(n for _, n in seen) == 3
    out = observer.windowed_best(stream, "ts", "kind", "total")
    asked = out.writeStream.outputMode("complete").format("memory").queryName("best").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    asked.awaitTermination(120)
    assert sorted((r["kind"], r["best_total"]) for r in spark.table("best").collect()) == [("a", 5.0), ("b", 2.0)]


def test_medians_of_large_groups(spark):
    rows = spark.range(20001).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20011).alias("a"), F.when(F.col("id") % 2 == 0, F.lit(-(2**62))).otherwise(2**62 + F.col("id")).alias("b"))
    values = [(r["a"], r["b"]) for r in rows.collect()]
    got = measurement.integer_medians(rows, ["g"], ["a", "b"]).first()
    assert (got["a"], got["b"]) == tuple(sorted(x)[10000] for x in zip(*values))
    assert measurement.lower_medians(rows.limit(20000), ["g"], "a").count() == 1


def test_small_rules(spark):
    assert folds.rate_applies(3, 1, 0) and not folds.rate_applies(3, 1, None) and not folds.rate_applies(0, 5, None)
    df = spark.createDataFrame([(4294967295,), (300000007,)], "n long")
    assert [r[0] for r in df.select(ranking.weight_total(F.col("n"))).collect()] == [n + n * (n - 1) // 2 for n in (4294967295, 300000007)]
    five = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "g int, i long, t double")
    assert sorted((r["elite_rank"], r["slot"], r["i"]) for r in ranking.elites(five, "g", "i", "t", 2).collect()) == [(0, 3, 4), (1, 4, 3)]


def test_candidates_hold_every_file(spark):
    """The fingerprint of a candidate: baseline, recipe, all files in order, edited or not, then the patches."""
    from lodestone.functions import fingerprint as prints

    files = {"a.c": b"v = v + w;\n", "b.c": b"int b;\n", "c.c": b""}
    df = spark.createDataFrame([(p, 0o755 if p == "b.c" else 0o644, c) for p, c in files.items()], "path string, mode long, content binary")
    at = {"form": "assignment-binary", "operator": "add", "primary_start": 0, "primary_end": 1, "duplicate_start": 4, "duplicate_end": 5, "operand_start": 8, "operand_end": 9, "primary_declaration": "d", "duplicate_declaration": "d", "plain_identifier": True, "type_matches": True}
    row = {"recipe": "r", "identity": "i", "path": "a.c", "source": "v = v + w;\n", "transformation": rewrites.ASSIGNMENT, "parameter": "add", "location_kind": "spelling", "target_start": 0, "target_end": 9}
    schema = "recipe string, identity string, path string, source string, transformation string, parameter string, location_kind string, target_start long, target_end long, " + rewrites.FACTS
    requests = spark.createDataFrame([tuple((row | at).get(c.split()[0], False if c.endswith("boolean") else 0 if c.split()[0].endswith(("_start", "_end")) else None) for c in schema.split(", "))], schema)
    records = spark.createDataFrame([("r", "i"), ("gone", "x")], "recipe string, identity string")
    heads = spark.createDataFrame([("r", "base", "rec"), ("gone", "base", "rec2")], "recipe string, baseline_fingerprint string, recipe_fingerprint string")
    stage = stages.materialize(records, requests, df, heads)
    said = {r["recipe"]: r for r in stage.results.collect()}
    assert said["gone"]["status"] == "refused" and said["r"]["status"] == "changed"
    new = files | {"a.c": b"v += w;\n"}
    state = prints.fnv1a_string("rec", prints.fnv1a_string("base", prints.fnv1a_string("project-candidate.v1")))
    state = prints.fnv1a_number(3, state)
    for p in sorted(new):
        state = prints.fnv1a_string(p, state)
        for n in (len(new[p]), 0o755 if p == "b.c" else 0o644, prints.fnv1a(new[p])):
            state = prints.fnv1a_number(n, state)
    state = prints.fnv1a(said["r"]["patch"].encode(), state)
    assert [tuple(r) for r in stage.fingerprints.collect()] == [("r", prints.text_form(state))]
    assert json.loads(stage.evidence.first()["json"])["candidate_fingerprint"] == prints.text_form(state)


def test_units_and_their_budgets(spark):
    units = spark.createDataFrame([("b.c",), ("a.c",), ("b.c",)], "file string")
    assert [r.file for r in analysis.translation_units(units, 2, 3).collect()] == ["a.c", "b.c"]
    for budgets, why in (((1, None), "limit"), ((None, 2), "path")):
        with pytest.raises(ValueError, match=why):
            analysis.translation_units(units, *budgets)
    with pytest.raises(ValueError, match="no translation units"):
        analysis.translation_units(units.limit(0), 5)


def test_resume_refuses_statistics_of_other_rows(spark, tmp_path):
    config = core.Config(8, 4, 3, 5, elite_count=2)
    problem = core.Problem(fitness=core.popcount("genome", 4))
    done = core.run(spark, problem, config, f"{tmp_path}/a")
    core.run(spark, problem, core.Config(8, 4, 1, 5, elite_count=2), f"{tmp_path}/b")
    assert core.resume(spark, problem, config, f"{tmp_path}/b", 1).history == done.history
    core.run(spark, problem, core.Config(8, 4, 1, 5, elite_count=2), f"{tmp_path}/c")
    core.run(spark, problem, core.Config(8, 4, 1, 6, elite_count=2), f"{tmp_path}/d")
    import shutil

    shutil.rmtree(f"{tmp_path}/c/generation=1")
    shutil.copytree(f"{tmp_path}/d/generation=1", f"{tmp_path}/c/generation=1")
    with pytest.raises(core.ConfigError, match="statistics"):
        core.resume(spark, problem, config, f"{tmp_path}/c", 1)
