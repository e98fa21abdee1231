"""Recipes, edits, text functions, measurements and containers on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import fingerprint, text, u64
from lodestone.operators import analysis, edits, measurement, population, recipes
from lodestone.sources import container, project, sinks


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_unsigned_arithmetic(spark):
    import random

    rng = random.Random(1)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(60)] + [(2**64 - 1, 2**64 - 1), (0, 0), (1 << 63, 1 << 63)]
    df = spark.createDataFrame([(u64.signed(a), u64.signed(b)) for a, b in pairs], "a long, b long")
    got = df.select(u64.add(F.col("a"), F.col("b")).alias("s"), u64.mul(F.col("a"), 6364136223846793005).alias("m"), u64.to_decimal(F.col("a")).alias("d"), u64.less(F.col("a"), F.col("b")).alias("l")).collect()
    for (a, b), r in zip(pairs, got):
        assert (r["s"] % 2**64, r["m"] % 2**64, int(r["d"]), r["l"]) == ((a + b) % 2**64, a * 6364136223846793005 % 2**64, a, a < b)


def test_fingerprints(spark):
    assert fingerprint.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert one(spark, fingerprint.fnv1a_record(F.array(F.lit("ab"), F.lit("c")))) != one(spark, fingerprint.fnv1a_record(F.array(F.lit("a"), F.lit("bc"))))
    assert one(spark, F.hex(fingerprint.crc32_blanked(F.lit(b"123456789"), 9, 0))) == "CBF43926"


@pytest.mark.parametrize("path, fine", [("a/b.c", True), ("", False), ("/a", False), ("a/", False), ("a//b", False), ("a/../b", False), ("./a", False), ("a\\b", False), ("c:x", False), ("a\x01", False)])
def test_relative_path(spark, path, fine):
    assert one(spark, text.relative_path_valid(F.col("p")), p=path) is fine


def test_text_functions(spark):
    assert one(spark, text.line_count(F.lit("a\nb"))) == 2 and one(spark, text.line_count(F.lit("a\n"))) == 1 and one(spark, text.line_count(F.lit(""))) == 0
    assert one(spark, text.byte_offset(F.lit("é\nxyz"), F.lit(2), F.lit(3))) == 5 and one(spark, text.byte_offset(F.lit("a"), F.lit(3), F.lit(1))) is None
    assert one(spark, text.shift_of_power(F.lit(8))) == 3 and one(spark, text.shift_of_power(F.lit(6))) is None
    assert one(spark, text.decimal_literal_value(F.lit("12uLL"))) == 12 and one(spark, text.decimal_literal_value(F.lit("12Ll"))) is None
    assert one(spark, text.interstitial_token(F.lit(" ( + ) ="), "+=")) is True
    assert one(spark, text.strict_long(F.lit("007"))) is None and one(spark, text.strict_long(F.lit("9223372036854775808"))) is None and one(spark, text.strict_long(F.lit("42"))) == 42
    assert [one(spark, text.strict_json_problem(F.col("j")), j=j) for j in ('{"a":1}', '{"a":1,"a":2}', "{", "NaN")] == [None, "duplicate-key", "syntax", "syntax"]
    assert one(spark, text.double_text(F.lit(0.1))) == "0.10000000000000001"


def test_apply_edits(spark):
    files = spark.createDataFrame([("a", b"int x = y * 8;"), ("b", b"keep"), ("c", b"abcdef"), ("d", b"zz")], "path string, content binary")
    todo = spark.createDataFrame(
        [("a", 8, 13, b"y * 8", b"(y << 3)", "r1"), ("a", 0, 3, b"int", b"long", "r2"), ("c", 0, 3, b"abc", b"x", "r1"), ("c", 2, 4, b"cd", b"y", "r2"), ("d", 0, 1, b"q", b"w", "r1")],
        "path string, start long, end long, before binary, after binary, identity string",
    )
    got = {r["path"]: (r["status"], bytes(r["content"])) for r in edits.apply_edits(files, todo).collect()}
    assert got == {"a": ("changed", b"long x = (y << 3);"), "b": ("unchanged", b"keep"), "c": ("overlap", b"abcdef"), "d": ("mismatch", b"zz")}


def test_patch(spark):
    got = one(spark, edits.whole_file_patch(F.lit("f"), F.lit("a\nb\n"), F.lit("c")))
    assert got == "--- a/f\n+++ b/f\n@@ -1,2 +1,1 @@\n-a\n-b\n+c\n\\ No newline at end of file\n"


def test_canonical_order(spark):
    assert recipes.canonical_order({"c": {"a"}, "b": set(), "a": {"b"}, "d": set()}) == ["b", "a", "c", "d"]
    with pytest.raises(recipes.RecipeError, match="cycle"):
        recipes.canonical_order({"a": {"b"}, "b": {"a"}})
    rows = spark.createDataFrame([(1, "x", "y"), (1, "y", None), (2, "p", "p")], "g int, identity string, dependency string")
    got = sorted((r["g"], r["position"], r["identity"]) for r in recipes.order_groups(rows, "g").collect())
    assert got == [(1, 0, "y"), (1, 1, "x"), (2, -1, "cycle")]


def test_recipe_operators():
    catalogue = [
        {"transformation": "t1", "version": 1, "mask": 1, "schemas": [{"name": "k", "kind": "integer", "minimum": 1, "maximum": 3}], "dependencies": ["t2"]},
        {"transformation": "t2", "version": 1, "mask": 2, "conflicts": []},
    ]
    spots = [{"rank": 1, "location": "l1", "kind": 1}, {"rank": 2, "location": "l2", "kind": 2}]
    r = recipes.add([], 0, spots, catalogue)
    assert r[0]["transformation"] == "t1" and r[0]["parameters"] == {"k": 1}
    fixed = recipes.repair(r + r, spots, catalogue)
    assert [x["transformation"] for x in fixed] == ["t1", "t2"] and fixed[1]["identity"] == "record-000001"
    assert recipes.repair(fixed, spots, catalogue) == fixed
    schemas = lambda x: catalogue[0]["schemas"] if x["transformation"] == "t1" else []
    three = recipes.parameterize(recipes.parameterize(r, 0, schemas), 0, schemas)
    assert three[0]["parameters"]["k"] == 3 and recipes.parameterize(three, 0, schemas)[0]["parameters"]["k"] == 1
    assert recipes.cross([1, 2, 3], [4, 5], (1 << 32) | 2) == ([1, 2, 5], [4, 3])
    assert recipes.reorder([1, 2, 3], 4) == [1, 3, 2] or len(recipes.reorder([1, 2, 3], 4)) == 3
    with pytest.raises(recipes.RecipeError):
        recipes.bind_parameters(catalogue[0]["schemas"], {"k": 9})


# The published comparison cases.
@pytest.mark.parametrize("candidate, verdict", [(800_000, "faster"), (1_005_000, "equal"), (1_200_000, "slower")])
def test_runtime_comparison(spark, candidate, verdict):
    assert one(spark, measurement.compare(F.lit(1_000_000), F.lit(candidate), 20_000, 50_000)) == verdict


def test_integer_medians(spark):
    rows = [("a", 9007199254740993), ("a", 9007199254740993), ("b", 3), ("b", 4), ("c", 5), ("c", 2**63 - 1), ("c", 2**63 - 2), ("c", 6)]
    got = {r["k"]: r["v"] for r in measurement.integer_medians(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"]).collect()}
    assert got == {"a": 9007199254740993, "b": 3, "c": (6 + 2**63 - 2) // 2}
    assert one(spark, measurement.range_ppm(F.lit(1), F.lit(2), F.lit(3))) == 333333 and one(spark, measurement.range_ppm(F.lit(0), F.lit(0), F.lit(0))) == 1_000_000


def test_diversity_forms_agree(spark):
    rows = [(0, i, bytes([i % 3, i % 2, 7])) for i in range(9)]
    df = spark.createDataFrame(rows, "g int, i long, genome binary")
    fast = population.byte_diversity(df, "g", "genome").first()
    slow = population.pair_diversity(df, "g", "i", F.expr("size(filter(sequence(1, 3), k -> substring(a.genome, k, 1) <> substring(b.genome, k, 1))) / 3"), budget=108, unit_work=3).first()
    with pytest.raises(ValueError):
        population.pair_diversity(df, "g", "i", F.lit(0), budget=107, unit_work=3)
    assert fast["pair_count"] == 36 and abs(fast["diversity"] - slow["diversity"]) < 1e-12
    with pytest.raises(ValueError):
        population.check_pair_budget(9, 3, 100)


def test_opportunity_order(spark):
    missed = spark.createDataFrame([("z",), ("z",), ("y",)], "loc string")
    runtime = spark.createDataFrame([("y", 100), ("x", 900)], "loc string, samples long")
    got = [(r["loc"], r["missed_optimization_count"], r["runtime_sample_count"]) for r in analysis.opportunities(missed, runtime, "loc", "samples").orderBy("rank").collect()]
    assert got == [("x", 0, 900), ("y", 1, 100), ("z", 2, 0)]


def test_container_refuses_damage(spark, tmp_path):
    sections = {s: s.encode() * k for k, s in enumerate(container.SECTIONS)}
    raw = container.encode(sections)
    assert container.decode(raw) == sections and len(raw) == container.size(sections)
    for k in range(0, len(raw), 7):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises(container.ContainerError):
            container.decode(bytes(bad))
        with pytest.raises(container.ContainerError):
            container.decode(raw[:k])
    (tmp_path / "a.bin").write_bytes(raw)
    assert container.read(spark, str(tmp_path)).first()["problem"] is None


def test_compilation_units(spark):
    db = '[{"directory":".","file":"lib/one.c","arguments":["cc","-c","lib/one.c"]},{"directory":".","file":"x.c","arguments":["cc"],"command":"cc"},{"directory":"/other","file":"y.c","command":"cc"}]'
    got = {(r["file"], r["problem"]) for r in project.compilation_units(spark.createDataFrame([(db,)], "v string"), "v", None, "/work").collect()}
    assert got == {("lib/one.c", None), ("x.c", "form"), (None, "path")}


def test_sinks_do_not_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "b")], "k int, v string")
    out = sinks.canonical_json(df, ["k"])
    assert out.first()["value"] == '[{"k":1,"v":"b"},{"k":2,"v":null}]'
    sinks.publish(out, f"{tmp_path}/e")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.publish(out, f"{tmp_path}/e")
