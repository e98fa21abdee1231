"""Node tables against plain walks, strict JSON against a plain parser, and source trees on disk."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import rewrites
from lodestone.sources import project, tree, trees

from . import brute_trees as brute

ASKED = "source string, transformation string, target_start long, target_end long, tree string, n long"


def node(rng, kind, a, b, **more):
    side = lambda x: {"expansionLoc": {"offset": x, "tokLen": 1}} if rng.random() < 0.04 else {"offset": x, "tokLen": 1}
    return {"kind": kind, "range": {"begin": side(a), "end": side(b - 1)}, **more}


def name(rng, a, b, identity=None):
    ref = {"id": identity or rng.choice(["0x1", "0x1", "0x1", "0x2"]), "name": "v", "type": {"qualType": rng.choice(["int", "int", "unsigned int"])}}
    if rng.random() < 0.05:
        ref.pop(rng.choice(list(ref)))
    more = {"referencedDecl": ref} if rng.random() < 0.95 else {}
    return node(rng, rng.choice(["DeclRefExpr"] * 9 + ["Other"]), a, b, **more)


def typed(rng, kind="int"):
    return {"type": {"qualType": rng.choice([kind, kind, kind, "long", "volatile int"])}} if rng.random() < 0.95 else {}


def some_request(rng):
    which = rng.randrange(4)
    if which == 0:
        source = rng.choice(["n = n - (a-b)", "n  =  n -x ", "é = n", "n = m - a", "n=n*y", "n = n -"])
        end = len(source.encode())
        left = [name(rng, 0, 1)]
        i = source.find("n", 1) if source.count("n") > 1 else 4
        right = node(rng, "BinaryOperator", i, len(source.rstrip()), opcode=rng.choice("---*"), **typed(rng), inner=[name(rng, i, i + 1)])
        inner = [node(rng, "BinaryOperator", 0, end, opcode="=", **typed(rng), inner=left + [right])]
        kind = rewrites.ASSIGNMENT
    elif which == 1:
        source = rng.choice(["n -= (a-b)", "n *=  y ", "n ^= ", "n -= __int128"])
        end = len(source)
        inner = [node(rng, "CompoundAssignOperator", 0, end, opcode=source.split()[1], **typed(rng), computeLHSType={"qualType": "int"}, computeResultType={"qualType": rng.choice(["int", "long"])}, inner=[name(rng, 0, 1)])]
        kind = rewrites.ASSIGNMENT
    elif which == 2:
        source = rng.choice(["!!a", " ! !a", "a == b", "!! (x) ", "!!", "   "])
        end = len(source)
        no = {"opcode": rng.choice("!!!-")}
        at = node(rng, rng.choice(["UnaryOperator"] * 4 + ["StmtExpr"]), 0, end, **no, inner=[node(rng, "UnaryOperator", 1, end, opcode=rng.choice("!!!~"))])
        statement = rng.choice(["IfStmt", "WhileStmt", "DoStmt", "ForStmt", "ReturnStmt"])
        children = [{}, None, node(rng, "Other", 0, 1)]
        place = rng.choice([0, 0, 1, 2])
        children = children[:place] + [at]
        inner = [node(rng, statement, 0, end + 1, inner=children)]
        kind = rewrites.CONDITION
    else:
        source = rng.choice(["v * 8U", "(v << 3)", "v*16", "(v * 8)", "v << 3", "(v << 3UL )", "v * x"])
        end = len(source)
        a, b = (1, end - 1) if source[0] == "(" and rng.random() < 0.9 else (0, end)
        digits = next((i for i, c in enumerate(source) if c.isdigit()), end - 1)
        stop = max(i for i, c in enumerate(source) if c.isalnum()) + 1
        literal = [node(rng, "IntegerLiteral", digits, stop)] * rng.choice([1] * 8 + [0, 2])
        inner = [node(rng, "BinaryOperator", a, b, opcode="<<" if "<<" in source else "*", **typed(rng, rng.choice(["unsigned int", "int"])), inner=[name(rng, a, a + 1), *literal])]
        kind = rewrites.SHIFT
    top = {"kind": "TranslationUnitDecl", "inner": inner * rng.choice([1] * 9 + [2])}
    said = json.dumps(top) if rng.random() < 0.96 else rng.choice(["{", "[1]", "7"])
    start = 0 if rng.random() < 0.96 else rng.choice([-1, 1, 50])
    return source, rng.choice([kind] * 19 + ["unheard-of"]), start, end, said


def test_facts_by_joins_are_those_of_walks(spark):
    rng = random.Random(11)
    rows = [(*some_request(rng), k) for k in range(700)]
    rows += [(*r[:5], 10_000 + r[5]) for r in rows[:20]]  # the same request twice
    got = {r["n"]: r for r in rewrites.tree_facts(spark.createDataFrame(rows, ASKED)).collect()}
    seen = set()
    for source, kind, start, end, said, n in rows:
        status, facts = brute.facts_of(kind, source.encode(), (start, end), said if said not in ("[1]", "7") else "{")
        assert got[n]["facts_status"] == status, (source, kind, start, end, said)
        seen.add((kind, status))
        for c in rewrites._FACT_NAMES if status == "found" else ():
            assert got[n][c] == facts.get(c), (c, source, said)
    assert {s for _, s in seen} == {"found", "facts-malformed", "not-applicable", "ambiguous-target", "catalogue-invalid"}
    assert {k for k, s in seen if s == "found"} == {rewrites.ASSIGNMENT, rewrites.CONDITION, rewrites.SHIFT}


def grown(rng, depth=0):
    kind = rng.choice(["FunctionDecl", "CompoundStmt", "VarDecl", "BinaryOperator", "BinaryOperator"])
    x = {"kind": kind, "name": rng.choice("fgh"), "loc": {"file": rng.choice(["a.c", "b.c"]), "line": rng.randrange(3), "col": 1}}
    if rng.random() < 0.3:
        x["storageClass"] = "static"
    a = rng.randrange(20)
    x = node(rng, a=a, b=a + rng.randrange(1, 4), **x) | {"opcode": rng.choice("+-")}
    if depth < 5:
        x["inner"] = [grown(rng, depth + 1) if rng.random() < 0.8 else {} for _ in range(rng.randrange(4))]
    return x


def test_node_tables_and_declarations(spark):
    rng = random.Random(3)
    units = [(f"u{k}", grown(rng)) for k in range(25)]
    df = spark.createDataFrame([(u, json.dumps(t)) for u, t in units] + [("bad", "{"), ("none", None)], "unit string, tree string")
    table = trees.nodes(df, "unit", "tree")
    rows = table.collect()
    by = {(r["unit"], r["pre"]): r for r in rows}
    for r in rows:
        if r["pre"] > 0:
            above = by[r["unit"], r["parent"]]
            assert above["pre"] < r["pre"] <= r["last"] <= above["last"] and above["depth"] == r["depth"] - 1
    assert {r["unit"] for r in rows if r["pre"] == -1} == {"bad", "none"}
    want = sorted((x for u, t in units for x in brute.function_rows(u, t)), key=str)
    assert sorted(map(tuple, project.function_declarations(df, "unit", "tree").collect()), key=str) == want
    asked = [(u, a, a + w, kind, op) for u in ("u0", "u1", "u2", "u3", "bad") for a in range(20) for w in (1, 2, 3) for kind, op in (("BinaryOperator", "+"), ("VarDecl", None))]
    got = trees.exact_nodes(spark.createDataFrame(asked, "unit string, target_start long, target_end long, kind string, opcode string"), table, "unit").collect()
    assert len(got) == len(asked)
    for r in got:
        hits = [x for x in brute._nodes(dict(units).get(r.unit, {})) if x["kind"] == r.kind and r.opcode in (None, x["opcode"]) and (brute.span(x) or ())[:2] == (r.target_start, r.target_end)]
        assert r.status == ("facts-malformed" if r.unit == "bad" else "found" if len(hits) == 1 else "ambiguous-target" if hits else "not-applicable")
        assert (r.pre is not None) == (r.status == "found")


# --- strict JSON


def plain_problem(v):
    class Duplicate(ValueError):
        pass

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise Duplicate
        return dict(items)

    def deep(x, d=0):
        return d > 64 or any(deep(y, d + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()))

    def refuse(_):
        raise ValueError

    if v is None:
        return "syntax"
    try:
        return "depth" if deep(json.loads(v, object_pairs_hook=pairs, parse_constant=refuse)) else None
    except Duplicate:
        return "duplicate-key"
    except ValueError:
        return "syntax"


def test_strict_json_without_python(spark):
    rng = random.Random(1)
    cases = [None, "", " ", "null", "[]", '{"a":1} x', '{"a":1}{"b":2}', "1][2", '1}{"x":2', "1,2", '{"a":1,"a":2}', '[{"k":1,"k":1}]', '{"\\u0061":1,"a":2}', "{'a':1}", "{a:1}", "[1,]", '{"a":NaN}', "[Infinity]"]
    cases += ['"\t"', '"\\ud800"', "01", "1.", "1e999", "123456789012345678901234567890", "/*c*/1", '"\\x"', "[1 2]", "﻿1", "-0", "+1", ".5", '{"a":"]["}', "true false", '"' + 'x\\"' * 5000 + '"', "[null]"]
    cases += ["[" * n + x + "]" * n for n in (63, 64, 65, 66, 300) for x in ("", "1", " ", '"[["', "[],[]")] + ['{"a":' * n + "1" + "}" * n for n in (64, 65)]
    base = ['{"a": [1, -2.5e3, "x\\n", {"b": null}], "c": {"d": [[], {}]}}', '[{"k":1,"l":[true,false]},"é😀"]']
    for _ in range(1500):
        b = list(rng.choice(base))
        for _ in range(rng.choice([1, 1, 2, 3])):
            i, o = rng.randrange(len(b)), rng.random()
            b[i : i + (o < 0.7)] = [] if o < 0.4 else [rng.choice('[]{},:"0-.eE\\ \ntfn1a')]
        cases.append("".join(b))
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v string").select("i", "v", text.strict_json_problem(F.col("v")).alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.v, r.p) for r in df.orderBy("i").collect() if r.p != plain_problem(r.v)] == []


# --- trees on disk


def grow_files(root):
    files = {"a.c": b"int a;\n", "src/b.c": b"", "src/.hidden": b"h" * 5, "src/_x/deep/c.h": b"\xff\x00", "lib/d.c": b"d" * 100, "z.txt": b"z"}
    for path, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(content)
    return files


def test_source_trees(spark, tmp_path):
    files = grow_files(tmp_path)
    got = project.source_tree(spark, str(tmp_path), 1000)
    assert [(r.path, r.size, bytes(r.content)) for r in got.collect()] == [(p, len(c), c) for p, c in sorted(files.items())]
    some = tree.read_tree(spark, f"file://{tmp_path}", ["src", "a.c"], max_files=10, max_total_bytes=100, max_path_bytes=20)
    assert sorted(r.path for r in some.collect()) == ["a.c", "src/.hidden", "src/_x/deep/c.h", "src/b.c"]
    rows = tree.read_tree(spark, str(tmp_path)).where("size < 100 and size >= 1 and path like 's%' and path <> 'src/_x/deep/c.h'")
    assert [r.path for r in rows.collect()] == ["src/.hidden"]


def test_filters_prune_before_files_are_opened(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    grow_files(tmp_path)
    reader = tree.TreeReader({"root": str(tmp_path)})
    assert [type(f) for f in reader.pushFilters([GreaterThan(("size",), 4), IsNotNull(("path",)), EqualTo(("path",), "lib/d.c")])] == [IsNotNull]
    assert [f for p in reader.partitions() for f in p.files] == [("lib/d.c", 100)]


@pytest.mark.parametrize(
    "roots, budgets, problem",
    [
        (["."], {"max_files": 5}, "max_files"), (["."], {"max_file_bytes": 99}, "max_file_bytes"), (["."], {"max_total_bytes": 110}, "max_total_bytes"), (["."], {"max_path_bytes": 10}, "max_path_bytes"),
        (["src", "src/b.c"], {}, "overlap"), (["no"], {}, "file-missing"), (["../x"], {}, "path"), (["/etc"], {}, "path"), (["empty"], {}, "empty"), (["linked"], {}, "link"),
    ],
)
def test_trees_that_are_refused(tmp_path, roots, budgets, problem):
    grow_files(tmp_path)
    os.mkdir(f"{tmp_path}/empty")
    if problem == "link":
        os.mkdir(f"{tmp_path}/linked")
        os.symlink(f"{tmp_path}/a.c", f"{tmp_path}/linked/a.c")
    with pytest.raises(tree.TreeError, match=problem):
        tree.listed(str(tmp_path), roots, budgets)
