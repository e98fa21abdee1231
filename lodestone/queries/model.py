"""Rules of the analysis tables, recipe records, genomes, rewrites and syntax trees on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import analysis, ordered, recipes, rewrites
from lodestone.sources import project

from ._sql import ascii_bytes, fnv
from ._tables import table

_LOCATIONS = """
SELECT 'l' || p_partkey AS identity, p_brand AS file, CAST(p_size AS BIGINT) AS line, 1 AS c1, CAST(p_size AS BIGINT) + p_partkey % 5 - 1 AS end_line, 1 AS c2,
       CASE p_partkey % 10 WHEN 0 THEN 'macro-expansion' WHEN 1 THEN 'generated' WHEN 2 THEN 'odd' ELSE 'spelling' END AS kind,
       CASE WHEN p_partkey % 20 = 0 THEN 'l' || (p_partkey + 3) WHEN p_partkey % 30 = 10 THEN 'l' || (p_partkey + 1) WHEN p_partkey % 30 = 3 THEN 'l1' END AS spelling FROM part"""


def _locations(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("l"), x)
    kind = F.when(k % 10 == 0, "macro-expansion").when(k % 10 == 1, "generated").when(k % 10 == 2, "odd").otherwise("spelling")
    spelling = F.when(k % 20 == 0, name(k + 3)).when(k % 30 == 10, name(k + 1)).when(k % 30 == 3, "l1")
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        name(k).alias("identity"), F.col("p_brand").alias("file"), size.alias("line"), F.lit(1).alias("column"), (size + k % 5 - 1).alias("end_line"), F.lit(1).alias("end_column"), kind.alias("kind"), spelling.alias("spelling")
    )


@query(f"""
WITH l AS ({_LOCATIONS}), s AS (SELECT identity FROM l WHERE kind = 'spelling'),
p AS (SELECT l.identity, CASE WHEN l.kind = 'odd' THEN 'kind' WHEN l.kind = 'generated' THEN 'generated-location' WHEN end_line < line OR line < 1 THEN 'range' WHEN l.kind = 'spelling' AND spelling IS NOT NULL THEN 'spelling-refers'
  WHEN l.kind = 'macro-expansion' AND spelling IS NULL THEN 'spelling-not-resolved' WHEN file = 'Brand#11' THEN 'file-not-captured' WHEN l.kind = 'macro-expansion' AND s.identity IS NULL THEN 'spelling-not-resolved' END AS problem
  FROM l LEFT JOIN s ON l.spelling = s.identity)
SELECT identity, problem FROM p WHERE problem IS NOT NULL
""")
def location_rules(spark, sf_dir):
    files = table(spark, sf_dir, "part").where("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("path"))
    return analysis.location_problems(_locations(spark, sf_dir), files)


_DECLARED = """
d AS (SELECT 'd' || s_suppkey AS identity, CASE WHEN s_suppkey % 4 = 0 THEN 'variable' WHEN s_suppkey % 9 = 0 THEN 'macro' ELSE 'function' END AS kind, CASE WHEN s_suppkey % 7 = 0 THEN 'odd' ELSE 'external' END AS linkage,
      n_name AS unit, 'l' || s_suppkey AS location, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT 'l' || p_partkey AS identity FROM part WHERE p_size < 45)"""


def _declared(spark, sf_dir):
    s = F.col("s_suppkey")
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    declarations = both.select(
        F.concat(F.lit("d"), s).alias("identity"), F.col("s_name").alias("name"), F.col("n_name").alias("unit"), F.concat(F.lit("l"), s).alias("location"),
        F.when(s % 4 == 0, "variable").when(s % 9 == 0, "macro").otherwise("function").alias("kind"), F.when(s % 7 == 0, "odd").otherwise("external").alias("linkage"),
    )
    return declarations, table(spark, sf_dir, "part").where("p_size < 45").select(F.concat(F.lit("l"), "p_partkey").alias("identity"))


@query(f"""
WITH {_DECLARED}, p AS (SELECT d.identity, CASE WHEN kind = 'macro' THEN 'kind' WHEN linkage = 'odd' THEN 'linkage' WHEN unit IN (SELECT n_name FROM nation WHERE n_nationkey % 6 = 0) THEN 'unit' WHEN l.identity IS NULL THEN 'location' END AS problem
FROM d LEFT JOIN l ON d.location = l.identity) SELECT identity, problem FROM p WHERE problem IS NOT NULL
""")
def declaration_rules(spark, sf_dir):
    declarations, locations = _declared(spark, sf_dir)
    return analysis.declaration_problems(declarations, table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("file")), locations)


_LINE = "SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS identity, 'd' || l_suppkey AS f, 'd' || (l_partkey % 50 + 1) AS g, 'l' || l_partkey AS location, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS r FROM lineitem"
_FUNCTIONS = "fn AS (SELECT identity FROM d WHERE kind = 'function')"


def _lines(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("string").alias("identity"), F.concat(F.lit("d"), "l_suppkey").alias("f"), F.concat(F.lit("d"), c("l_partkey") % 50 + 1).alias("g"),
        F.concat(F.lit("l"), "l_partkey").alias("location"), c("l_linenumber").alias("n"), c("l_quantity").cast("long").alias("q"), c("l_returnflag").alias("r"),
    )


def _rule_sql(check: str, refs: list[tuple[str, str, str]]) -> str:
    joins = " ".join(f"LEFT JOIN {t} AS j{k} ON x.{c} = j{k}.identity" for k, (_, c, t) in enumerate(refs))
    missing = " ".join(f"WHEN j{k}.identity IS NULL THEN '{name}'" for k, (name, _, _) in enumerate(refs))
    return f"WITH {_DECLARED}, {_FUNCTIONS}, x AS ({_LINE}), p AS (SELECT x.identity, CASE {check} {missing} WHEN count(*) OVER (PARTITION BY x.identity) > 1 THEN 'duplicate' END AS problem FROM x {joins}) SELECT problem, count(*) AS records, min(identity) AS first_identity FROM p WHERE problem IS NOT NULL GROUP BY problem"


def _told(problems):
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("records"), F.min("identity").alias("first_identity"))


@query(_rule_sql("WHEN n % 5 = 0 THEN 'kind'", [("caller", "f", "fn"), ("callee", "g", "fn"), ("location", "location", "l")]))
def call_rules(spark, sf_dir):
    declarations, locations = _declared(spark, sf_dir)
    kind = F.when(F.col("n") % 5 == 0, "odd").when(F.col("n") % 2 == 0, "direct").otherwise("indirect")
    return _told(analysis.call_problems(_lines(spark, sf_dir).select("identity", F.col("f").alias("caller"), F.col("g").alias("callee"), "location", kind.alias("kind")), declarations, locations))


@query(_rule_sql("WHEN n = 6 THEN 'kind' WHEN q % 10 = 0 THEN 'block'", [("function", "f", "fn"), ("location", "location", "l")]))
def control_rules(spark, sf_dir):
    declarations, locations = _declared(spark, sf_dir)
    kind = F.coalesce(F.get(F.array(*map(F.lit, analysis.CONTROL_KINDS)), F.col("n") - 1), F.when(F.col("n") == 6, "odd"), F.lit("return"))
    rows = _lines(spark, sf_dir).select("identity", F.col("f").alias("function"), "location", kind.alias("kind"), F.lit("b0").alias("from_block"), F.when(F.col("q") % 10 == 0, "").otherwise("b1").alias("to_block"))
    return _told(analysis.control_problems(rows, declarations, locations))


@query(_rule_sql("WHEN r = 'R' THEN 'kind'", [("function", "f", "fn"), ("declaration", "g", "d"), ("location", "location", "l")]))
def data_rules(spark, sf_dir):
    declarations, locations = _declared(spark, sf_dir)
    kind = F.when(F.col("r") == "A", "read").when(F.col("r") == "N", "write").otherwise("odd")
    rows = _lines(spark, sf_dir).select("identity", F.col("f").alias("function"), F.col("g").alias("declaration"), "location", kind.alias("kind"))
    return _told(analysis.data_problems(rows, declarations, locations))


@query(_rule_sql("WHEN r = 'A' THEN 'disposition' WHEN q % 7 = 0 THEN 'text'", [("function", "f", "fn"), ("location", "location", "l")]))
def optimization_rules(spark, sf_dir):
    declarations, locations = _declared(spark, sf_dir)
    rows = _lines(spark, sf_dir).select("identity", F.col("f").alias("function"), "location", F.when(F.col("r") == "A", "odd").otherwise("missed").alias("disposition"), F.lit("inline").alias("pass"), F.when(F.col("q") % 7 == 0, "").otherwise("not inlined").alias("message"))
    return _told(analysis.optimization_problems(rows, declarations, locations))


@query(_rule_sql("WHEN n = 7 THEN 'metric' WHEN q % 5 = 0 THEN 'value' WHEN r = 'N' THEN 'workload'", [("function", "f", "fn"), ("location", "location", "l")]))
def runtime_rules(spark, sf_dir):
    declarations, locations = _declared(spark, sf_dir)
    rows = _lines(spark, sf_dir).select("identity", F.col("r").alias("workload"), F.col("f").alias("function"), "location", F.when(F.col("n") == 7, "cycles").otherwise("sample-count").alias("metric"), (F.col("q") % 5).alias("value"))
    workloads = spark.createDataFrame([("A",), ("R",)], "workload string")
    return _told(analysis.runtime_problems(rows, workloads, declarations, locations))


# --- recipes

_ENTRY = "array<struct<transformation: string, version: int>>"
_CATALOGUE = [("t0", 1, 3, [("t1", 1)], []), ("t1", 1, 1, [], [("t2", 1)]), ("t2", 1, 2, [], []), ("t3", 1, 3, [("t2", 1)], []), ("t4", 1, 3, [], [])]


def _catalogue(spark):
    return spark.createDataFrame(_CATALOGUE, f"transformation string, version int, mask long, dependencies {_ENTRY}, conflicts {_ENTRY}")


@query("""
WITH p AS (SELECT CAST(p_partkey // 3 AS VARCHAR) AS recipe, 'r' || p_partkey AS identity, p_partkey, p_partkey % 60 AS place, p_size % 6 AS t, CASE WHEN p_partkey % 29 = 0 THEN 2 ELSE 1 END AS v FROM part),
n AS (SELECT recipe, count(*) FILTER (t = 0 AND v = 1) AS c0, count(*) FILTER (t = 1 AND v = 1) AS c1, count(*) FILTER (t = 2 AND v = 1) AS c2 FROM p GROUP BY recipe),
s AS (SELECT p.*, CASE WHEN t = 5 OR v = 2 THEN 'unknown-transformation' WHEN place >= 45 OR (t = 1 AND place % 2 = 1) OR (t = 2 AND place % 2 = 0) THEN 'stale-target' WHEN place % 11 = 0 THEN 'analysis-stale'
  WHEN (t = 0 AND c1 = 0) OR (t = 3 AND c2 = 0) THEN 'dependency-missing' WHEN (t = 0 AND c1 > 1) OR (t = 3 AND c2 > 1) THEN 'dependency-ambiguous' WHEN t = 1 AND c2 > 0 THEN 'conflict' ELSE 'ok' END AS status FROM p JOIN n USING (recipe))
SELECT recipe, identity, status, CASE WHEN place < 45 THEN CAST(place + 1 AS BIGINT) ELSE -1 END AS opportunity_rank, CAST(CASE WHEN place >= 45 THEN 0 WHEN place % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS evidence FROM s
""")
def recipe_records(spark, sf_dir):
    """Proposals met with the catalogue, their places, opportunities and evidence; three records to a recipe."""
    k = F.col("p_partkey")
    proposals = table(spark, sf_dir, "part").select(F.expr("p_partkey div 3").cast("string").alias("recipe"), F.concat(F.lit("r"), k).alias("identity"), F.concat(F.lit("loc"), k % 60).alias("target"), F.concat(F.lit("t"), F.col("p_size") % 6).alias("transformation"), F.when(k % 29 == 0, 2).otherwise(1).alias("version"))
    i = F.col("id")
    place = spark.range(50).select(i, F.concat(F.lit("loc"), i).alias("location"))
    locations = place.select(F.col("location").alias("identity"), F.lit("f.c").alias("file"), F.when(i % 2 == 0, "spelling").otherwise("macro-expansion").alias("kind"))
    chances = place.where("id < 45").select("location", (i + 1).alias("rank"), F.when(i % 11 == 0, 7).otherwise(1).alias("missed_optimization_count"), (i % 3 == 0).alias("runtime_evidence_present"))
    missed = place.where("id < 45").select("location", F.concat(F.lit("m"), i).alias("identity"))
    runtime = place.where("id < 45 and id % 3 = 0").select("location", F.concat(F.lit("s"), i).alias("identity"))
    out = recipes.build_records(proposals, _catalogue(spark), locations, chances, missed, runtime, {"spelling": 1, "macro-expansion": 2})
    evidence = (F.size("compiler_records") + F.size("runtime_records")).cast("long")
    return out.select("recipe", "identity", "status", F.coalesce("opportunity_rank", F.lit(-1).cast("long")).alias("opportunity_rank"), evidence.alias("evidence"))


@query("""
WITH p AS (SELECT p_partkey, '[{"name":"' || p_name || '","size":' || p_size || '}]' AS payload FROM part),
g AS (SELECT *, CASE WHEN strlen(payload) + 16 < 48 THEN hex(encode('RECIPE01')) || printf('%02X', CAST(strlen(payload) AS INTEGER)) || repeat('00', 7) || hex(encode(payload)) || repeat('00', CAST(48 - 16 - strlen(payload) AS INTEGER)) END AS genome FROM p)
SELECT p_partkey, coalesce(genome, 'too-long') AS genome, CASE WHEN genome IS NOT NULL AND p_partkey % 5 <> 0 THEN payload ELSE 'refused' END AS payload, """ + fnv(ascii_bytes("payload")) + """ AS fingerprint FROM g
""")
def recipe_genomes(spark, sf_dir):
    """Recipes into genomes of 48 bytes and back; one in five is damaged on the way."""
    payload = F.concat(F.lit('[{"name":"'), "p_name", F.lit('","size":'), F.col("p_size").cast("string"), F.lit("}]"))
    rows = table(spark, sf_dir, "part").select("p_partkey", payload.alias("payload")).withColumn("genome", recipes.genome_column(F.col("payload"), 48))
    broken = F.concat(F.substring("genome", 1, 47), F.unhex(F.lit("07")))
    back = recipes.payload_column(F.when(F.col("p_partkey") % 5 == 0, broken).otherwise(F.col("genome")))
    return rows.select("p_partkey", F.coalesce(F.hex("genome"), F.lit("too-long")).alias("genome"), F.coalesce(back, F.lit("refused")).alias("payload"), recipes.fingerprint_column(F.col("payload")).alias("fingerprint"))


@query("""
WITH e AS (SELECT row_number() OVER (ORDER BY p_partkey) AS position, p_name || p_partkey AS t, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE 1 END AS v, p_size % 5 AS mask, p_partkey FROM part),
b AS (SELECT *, lag(t) OVER (ORDER BY position) AS bt, lag(v) OVER (ORDER BY position) AS bv, lead(t) OVER (ORDER BY position) AS nt, lead(v) OVER (ORDER BY position) AS nv FROM e),
p AS (SELECT t AS transformation, v AS version, CASE WHEN v = 0 THEN 'identity' WHEN mask NOT IN (1, 2, 3) THEN 'location-kinds' WHEN bt > t OR (bt = t AND bv >= v) THEN 'order' WHEN p_partkey % 7 = 0 THEN 'refers-to-itself'
  WHEN p_partkey % 11 = 0 THEN 'unknown-reference' WHEN p_partkey % 13 = 0 AND nt IS NOT NULL THEN 'needed-and-refused' END AS problem FROM b)
SELECT transformation, version, problem FROM p WHERE problem IS NOT NULL
""")
def catalogue_rules(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat("p_name", k).alias("transformation"), F.when(k % 17 == 0, 0).otherwise(1).alias("version"), (F.col("p_size") % 5).cast("long").alias("mask"))
    rows = ordered.total_rank(rows, [k], "position").withColumn("position", F.col("position") + 1)
    ref = lambda t, v: F.struct(t.alias("transformation"), v.alias("version"))
    none = F.array().cast(_ENTRY)
    here, next_ = ref(F.col("transformation"), F.col("version")), F.col("next")
    rows = rows.join(rows.select((F.col("position") - 1).alias("position"), here.alias("next")), "position", "left")
    needs = F.when(k % 7 == 0, F.array(here)).when(k % 11 == 0, F.array(ref(F.lit("nowhere"), F.lit(1)))).when((k % 13 == 0) & next_.isNotNull(), F.array(next_)).otherwise(none)
    rows = rows.withColumn("dependencies", needs).withColumn("conflicts", F.when((k % 13 == 0) & (k % 7 != 0) & (k % 11 != 0) & next_.isNotNull(), F.array(next_)).otherwise(none))
    return recipes.catalogue_problems(rows, 3)


# --- rewrites

_SIGNS = {0: "+", 1: "&", 2: "|", 3: "^", 4: "*", 5: "-", 6: "/"}
_SIGN = "CASE p_size % 7 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in _SIGNS.items()) + " END"
_WORD = "CASE p_size % 7 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate([*rewrites.OPERATORS, "divide"])) + " END"


def _facts(rows, **given):
    """Facts that are not given: absent, zero or false."""
    out = rows
    for part in rewrites.FACTS.split(", "):
        name, kind = part.split()[0], part.split()[1]
        value = given.get(name, F.lit(0) if name.endswith(("_start", "_end")) else F.lit(False) if kind == "boolean" else F.lit(None))
        out = out.withColumn(name, value.cast(kind if kind != "decimal(20,0)" else "decimal(20,0)"))
    return out


@query(f"""
WITH p AS (SELECT p_partkey AS k, 'v' || p_partkey AS v, {_SIGN} AS sign, CASE WHEN p_partkey % 23 = 0 THEN '(a /* x */ - b)' ELSE 'a' || p_size || ' - b' END AS operand, p_size % 7 AS w FROM part)
SELECT k AS p_partkey, s AS status, CASE WHEN s = 'edit' THEN v || ' ' || sign || '= ' || operand ELSE '' END AS replacement FROM (
  SELECT *, CASE WHEN k % 11 = 0 THEN 'unsupported-macro' WHEN k % 23 = 0 THEN 'unsupported-comment' WHEN w = 6 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 THEN 'not-applicable' ELSE 'edit' END AS s FROM p)
""")
def assignment_rewrites(spark, sf_dir):
    """`x = x op (...)` with operands of several parts; facts that stand in the way refuse the rewrite."""
    k = F.col("p_partkey")
    v = F.concat(F.lit("v"), k)
    operand = F.when(k % 23 == 0, "(a /* x */ - b)").otherwise(F.concat(F.lit("a"), "p_size", F.lit(" - b")))
    rows = table(spark, sf_dir, "part").select(k, F.concat(v, F.lit(" = "), v, F.lit(" "), F.expr(_SIGN), F.lit(" "), operand).alias("source"), F.lit(rewrites.ASSIGNMENT).alias("transformation"), F.expr(_WORD).alias("parameter"), F.lit("spelling").alias("location_kind"), F.length(v).alias("n"))
    n, end = F.col("n"), F.octet_length("source")
    rows = rows.withColumn("target_start", F.lit(0)).withColumn("target_end", end)
    rows = _facts(
        rows, form=F.lit("assignment-binary"), operator=F.col("parameter"), primary_start=F.lit(0), primary_end=n, duplicate_start=n + 3, duplicate_end=2 * n + 3, operand_start=2 * n + 6, operand_end=end,
        primary_declaration=F.lit("d"), duplicate_declaration=F.when(k % 19 == 0, "e").otherwise("d"), plain_identifier=F.lit(True), type_matches=k % 17 != 0, volatile=k % 13 == 0, contains_macro=k % 11 == 0,
    )
    return rewrites.rewrites(rows).select("p_partkey", "status", F.coalesce("replacement", F.lit("")).alias("replacement"))


@query("""
WITH p AS (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN '!!' WHEN 1 THEN '! !' WHEN 2 THEN '!' ELSE '' END AS nots, 'ready' || p_partkey AS e, p_size % 4 AS f FROM part)
SELECT k AS p_partkey, CASE WHEN k % 13 = 0 OR k % 5 = 0 THEN 'not-applicable' WHEN f = 3 THEN 'already-satisfied' WHEN f = 2 THEN 'facts-malformed' ELSE 'edit' END AS status,
       CASE WHEN k % 13 = 0 OR k % 5 = 0 OR f >= 2 THEN '' ELSE e END AS replacement FROM p
""")
def condition_rewrites(spark, sf_dir):
    k, f = F.col("p_partkey"), F.col("p_size") % 4
    nots = F.when(f == 0, "!!").when(f == 1, "! !").when(f == 2, "!").otherwise("")
    rows = table(spark, sf_dir, "part").select(k, F.concat(F.lit("if ("), nots, F.lit("ready"), k, F.lit(") go();")).alias("source"), F.lit(rewrites.CONDITION).alias("transformation"), F.lit("if").alias("parameter"), F.lit("spelling").alias("location_kind"), F.length(nots).alias("n"), f.alias("f"))
    end = F.octet_length("source") - 7
    rows = rows.withColumn("target_start", F.lit(4)).withColumn("target_end", end)
    rows = _facts(rows, form=F.when(F.col("f") == 3, "scalar-condition").otherwise("double-negated-condition"), context=F.when(k % 5 == 0, "while").otherwise("if"), operand_start=4 + F.col("n"), operand_end=end, scalar=F.lit(True), volatile=k % 13 == 0)
    return rewrites.rewrites(rows).select("p_partkey", "status", F.coalesce("replacement", F.lit("")).alias("replacement"))


_TREE = (
    '{"kind":"TranslationUnitDecl","inner":[{"kind":"BinaryOperator","opcode":"*","range":{"begin":{"offset":0,"tokLen":1},"end":{"offset":@END@,"tokLen":1}},"type":{"qualType":"@TYPE@"},"inner":['
    '{"kind":"DeclRefExpr","range":{"begin":{"offset":0,"tokLen":@NAME@},"end":{"offset":0,"tokLen":@NAME@}},"referencedDecl":{"id":"0x1","name":"v","type":{"qualType":"@OTHER@"}}},'
    '{"kind":"IntegerLiteral","range":{"begin":{"offset":@AT@,"tokLen":1},"end":{"offset":@END@,"tokLen":1}}}]}]}'
)


@query("""
WITH p AS (SELECT p_partkey AS k, 'v' || p_partkey AS v, p_size AS n, CASE p_partkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 8 ELSE 0 END AS width FROM part),
s AS (SELECT *, CASE WHEN width = 0 THEN 'not-applicable' ELSE 'found' END AS facts, CASE WHEN n >= 2 AND bit_count(n) = 1 THEN CAST(round(log2(n)) AS BIGINT) ELSE 0 END AS shift FROM p)
SELECT k AS p_partkey, facts AS facts_status, CASE WHEN width > 0 AND k % 9 <> 0 AND shift > 0 AND shift <= 4 AND shift < width THEN 'edit' ELSE 'not-applicable' END AS status,
       CASE WHEN width > 0 AND k % 9 <> 0 AND shift > 0 AND shift <= 4 AND shift < width THEN '(' || v || ' << ' || shift || ')' ELSE '' END AS replacement FROM s
""")
def shift_rewrites(spark, sf_dir):
    """`x * 2^k` with facts from recorded trees: only unsigned types of the operand's own type are shifted."""
    k = F.col("p_partkey")
    v = F.concat(F.lit("v"), k)
    source = F.concat(v, F.lit(" * "), "p_size", F.lit("U"))
    kind = F.when(k % 4 == 0, "unsigned int").when(k % 4 == 1, "unsigned long").when(k % 4 == 2, "unsigned char").otherwise("int")
    tree = F.lit(_TREE)
    for mark, value in (("@END@", F.length("source") - 1), ("@NAME@", F.length(v)), ("@AT@", F.length(v) + 3), ("@TYPE@", kind), ("@OTHER@", F.when(k % 9 == 0, "short").otherwise(kind))):
        tree = F.replace(tree, F.lit(mark), value.cast("string"))
    rows = table(spark, sf_dir, "part").select(k, source.alias("source")).withColumn("tree", tree).withColumn("transformation", F.lit(rewrites.SHIFT)).withColumn("parameter", F.lit("4")).withColumn("location_kind", F.lit("spelling"))
    rows = rows.withColumn("target_start", F.lit(0).cast("long")).withColumn("target_end", F.length("source").cast("long"))
    return rewrites.rewrites(rewrites.tree_facts(rows)).select("p_partkey", "facts_status", "status", F.coalesce("replacement", F.lit("")).alias("replacement"))


# --- compiler flags

_FLAG_CASES = {
    0: (["cc", "-std=c17", "-O2", "-Wall", "-I", "include", "-DX=1", "-c", "a.c", "-o", "a.o"], "-std=c17 -I include -DX=1"),
    1: (["cc", "-I../../etc", "a.c"], None), 2: (["cc", "-I", "/usr/include"], None), 3: (["cc", "-Ilib/x", "-UY", "-pthread", "b.c"], "-Ilib/x -UY"),
    4: (["cc", "-include", "x.h"], None), 5: (["cc", "-fsanitize=address"], None), 6: (["cc", "-o"], None), 7: (["cc", "-D@x"], None), 8: (["cc"], ""), 9: (["cc", "-std=c++17", "x", "-g", "-pipe"], "-std=c++17"),
}


@query("SELECT c_custkey, CASE c_custkey % 10 " + " ".join(f"WHEN {k} THEN '{'unsupported' if kept is None else kept}'" for k, (_, kept) in _FLAG_CASES.items()) + " END AS flags FROM customer")
def compiler_flags(spark, sf_dir):
    arguments = F.lit(None).cast("array<string>")
    for k, (args, _) in _FLAG_CASES.items():
        arguments = F.when(F.col("c_custkey") % 10 == k, F.array(*map(F.lit, args))).otherwise(arguments)
    kept, supported = project.build_arguments(F.col("arguments"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", arguments.alias("arguments"))
    return rows.select("c_custkey", F.when(supported, F.array_join(kept, " ")).otherwise("unsupported").alias("flags"))
