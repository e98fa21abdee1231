"""Text predicates, literals, lines, JSON members, patches and recipe orders on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.functions import text
from lodestone.operators import edits, recipes
from lodestone.sources import project, trees

from ._sql import ascii_bytes, fnv
from ._tables import scratch, table


@query("""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'src//' || page_id WHEN 1 THEN '/abs/' || page_id WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN 'c:' || page_id ELSE 'lib/x' || page_id || '.c' END AS path FROM pages)
SELECT page_id, path, path <> '' AND NOT regexp_matches(path, '[\\x00-\\x1F\\x7F\\\\:]') AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS path_valid FROM p
""")
def relative_paths(spark, sf_dir):
    path = F.expr("CASE page_id % 5 WHEN 0 THEN concat('src//', page_id) WHEN 1 THEN concat('/abs/', page_id) WHEN 2 THEN concat('a/../', page_id) WHEN 3 THEN concat('c:', page_id) ELSE concat('lib/x', page_id, '.c') END")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", text.relative_path_valid(F.col("path")).alias("path_valid"))


@query("""
SELECT p_partkey, CASE WHEN p_size >= 2 AND bit_count(p_size) = 1 THEN CAST(round(log2(p_size)) AS BIGINT) ELSE -1 END AS shift,
       regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z_][A-Za-z0-9_]*$') AS identifier FROM part
""")
def shifts_and_identifiers(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(text.shift_of_power(size), F.lit(-1).cast("long")).alias("shift"), text.is_identifier(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("identifier"))


@query("SELECT doc_id, CAST(strlen(text) - strlen(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("lines"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 2 AND strlen(l[2]) >= 2 THEN CAST(strlen(l[1]) + 1 + 2 AS BIGINT) ELSE -1 END AS byte_offset FROM l
""")
def byte_offsets(spark, sf_dir):
    at = text.byte_offset(F.col("text"), F.lit(2), F.lit(3))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(at, F.lit(-1).cast("long")).alias("byte_offset"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(list_filter(json_keys(props), lambda x: x <> 'k')) = 0 AS closed, true AS strict FROM events
""")
def strict_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))
    return rows.select("event_id", text.strict_long(F.col("k")).alias("k"), text.only_keys(F.col("props"), ["k"]).alias("closed"), text.strict_json_problem(F.col("props")).isNull().alias("strict"))


@query("""
WITH t AS (SELECT conv_id, turn, text AS before, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS after FROM conversations),
s AS (SELECT conv_id, turn, 'conv/' || conv_id AS p, before, after, string_split(regexp_replace(before, '\\n$', ''), chr(10)) AS b, string_split(regexp_replace(after, '\\n$', ''), chr(10)) AS a FROM t WHERE after IS NOT NULL AND before <> '' AND after <> '')
SELECT conv_id, turn, md5('--- a/' || p || chr(10) || '+++ b/' || p || chr(10) || '@@ -1,' || len(b) || ' +1,' || len(a) || ' @@' || chr(10)
  || array_to_string(list_transform(b, lambda x: '-' || x), chr(10)) || CASE WHEN ends_with(before, chr(10)) THEN chr(10) ELSE chr(10) || '\\ No newline at end of file' || chr(10) END
  || array_to_string(list_transform(a, lambda x: '+' || x), chr(10)) || CASE WHEN ends_with(after, chr(10)) THEN chr(10) ELSE chr(10) || '\\ No newline at end of file' || chr(10) END) AS patch_md5 FROM s
""")
def unified_patch(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("before"), F.lead("text").over(w).alias("after")).where("after is not null and before <> '' and after <> ''")
    return rows.select("conv_id", "turn", F.md5(edits.whole_file_patch(F.concat(F.lit("conv/"), F.col("conv_id")), F.col("before"), F.col("after"))).alias("patch_md5"))


@query("""
SELECT s_suppkey, printf('record-%06d', CAST(s_suppkey AS INTEGER)) AS record_name, CASE WHEN s_suppkey % 3 = 0 THEN 'a/b' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'outside' ELSE 'c' || s_suppkey END AS normal FROM supplier
""")
def names_and_paths(spark, sf_dir):
    path = F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('/root/x/../a//./b', s_suppkey) WHEN 1 THEN concat('/root/../etc/', s_suppkey) ELSE concat('/root/c', s_suppkey) END")
    normal = F.coalesce(text.normalize_path(path, F.lit("/root/")), F.lit("outside"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.record_name(F.col("s_suppkey")).alias("record_name"), normal.alias("normal"))


@query("SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS position, printf('r%05d', CAST(s_suppkey AS INTEGER)) AS identity FROM supplier")
def canonical_order(spark, sf_dir):
    """Dependency-first order of each nation's suppliers: every one needs its half, if that is of the nation."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    half = s.select(F.col("s_nationkey").alias("n2"), F.col("s_suppkey").alias("k2"))
    joined = s.join(half, (F.col("s_nationkey") == F.col("n2")) & (F.expr("s_suppkey div 2") == F.col("k2")) & (F.col("s_suppkey") > 1), "left")
    name = lambda c: F.format_string("r%05d", F.col(c))
    return recipes.order_groups(joined.select("s_nationkey", name("s_suppkey").alias("identity"), F.when(F.col("k2").isNotNull(), name("k2")).alias("dependency")), "s_nationkey")


@query("""
WITH l AS (SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS a FROM part WHERE p_size <= 10 GROUP BY p_brand), r AS (SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS b FROM part WHERE p_size > 40 GROUP BY p_brand),
c AS (SELECT p_brand, a, b, CAST((len(b) // 3 * 4294967296 + len(a) // 2) % (len(a) + 1) AS BIGINT) AS i, len(b) // 3 AS j FROM l JOIN r USING (p_brand))
SELECT p_brand, array_to_string(list_concat(a[1:i], b[j + 1:]), ',') AS child_a, array_to_string(list_concat(b[1:j], a[i + 1:]), ',') AS child_b FROM c
""")
def recipe_splice(spark, sf_dir):
    """Prefix of one list and suffix of another, both ways; lists are recipes, whose length is bounded."""
    p = table(spark, sf_dir, "part")
    pick = lambda where, name: p.where(where).groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias(name))
    both = pick("p_size <= 10", "a").join(pick("p_size > 40", "b"), "p_brand")
    both = both.withColumn("selector", F.expr("(size(b) div 3) * 4294967296L + size(a) div 2"))
    out = recipes.spliced(both, "p_brand", "a", "b", "selector")
    return out.select("p_brand", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("child_a", "child_b")])


@query("""
WITH r AS (SELECT DISTINCT p_brand AS record FROM part), a AS (SELECT p_brand AS record FROM part WHERE p_size = 1 UNION ALL SELECT 'Brand#none'), n AS (SELECT record, count(*) AS c FROM a GROUP BY record)
SELECT coalesce(r.record, n.record) AS record, coalesce(c, 0) AS applications, CASE WHEN r.record IS NULL THEN 'unknown' WHEN c IS NULL THEN 'missing' WHEN c > 1 THEN 'duplicate' ELSE 'matched' END AS status
FROM r FULL JOIN n ON r.record = n.record
""")
def application_status(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("record"), "p_size")
    applied = p.where("p_size = 1").select("record").union(spark.createDataFrame([("Brand#none",)], "record string"))
    return edits.application_status(p.select("record"), applied, "record")


@query("""
WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS path, hex(encode(text)) AS old FROM documents),
n AS (SELECT path, old, strlen(old) >= 24 AS edited, CASE WHEN strlen(old) >= 24 THEN '3C656469743E' || old[9:16] || '3C656469743E' || old[25:] ELSE old END AS new FROM h)
SELECT path, CASE WHEN edited THEN 'changed' ELSE 'unchanged' END AS status, CAST(CASE WHEN edited THEN 2 ELSE 0 END AS BIGINT) AS edit_count, CAST(strlen(old) // 2 AS BIGINT) AS before_size,
       CAST(strlen(new) // 2 AS BIGINT) AS after_size, md5(new) AS content_md5 FROM n
""")
def applied_edits(spark, sf_dir):
    """Two edits in every document: its first four bytes, and the four from place 8, if it has them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    cut = lambda start: F.struct(F.lit(start).alias("start"), F.lit(start + 4).alias("end"), F.substring("content", start + 1, 4).alias("before"), F.encode(F.lit("<edit>"), "utf-8").alias("after"), F.lit(f"e{start}").alias("identity"))
    todo = d.where(F.octet_length("content") >= 12).select("path", F.explode(F.array(cut(8), cut(0))).alias("e")).select("path", "e.*")
    return edits.apply_edits(d, todo).select("path", "status", "edit_count", "before_size", "after_size", F.md5(F.hex("content")).alias("content_md5"))


# --- trees


def _node(kind: str, start: str, end: str, more: str = "") -> str:
    return f'{{"kind":"{kind}","range":{{"begin":{{"offset":{start},"tokLen":1}},"end":{{"offset":{end},"tokLen":1}}}}{more}}}'


def _unit_trees(spark, sf_dir):
    """A unit for each nation: suppliers are functions, static where their number is even, defined where it is no multiple
    of 3, each with a sum of its number's place; suppliers of a multiple of 10 come twice."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    at = '"loc":{"file":"@NATION@.c","line":@LINE@,"col":1}'
    function = '{"kind":"FunctionDecl","name":"f@LINE@",' + at + '@STATIC@,"inner":[' + _node("ParmVarDecl", "0", "0") + '@BODY@]}'
    body = ',{"kind":"CompoundStmt","inner":[' + _node("BinaryOperator", "@LINE@0", "@LINE@5", ',"opcode":"+"') + "]}"
    text_ = F.lit(function)
    for mark, value in (("@STATIC@", F.when(n % 2 == 0, ',"storageClass":"static"').otherwise("")), ("@BODY@", F.when(n % 3 != 0, body).otherwise("")), ("@NATION@", F.col("s_nationkey").cast("string")), ("@LINE@", k)):
        text_ = F.replace(text_, F.lit(mark), value)
    functions = table(spark, sf_dir, "supplier").select("s_nationkey", n, F.when(n % 10 == 0, F.concat(text_, F.lit(","), text_)).otherwise(text_).alias("f"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "f"))), lambda x: x["f"]), ",")
    return functions.groupBy("s_nationkey").agg(F.concat(F.lit('{"kind":"TranslationUnitDecl","inner":['), inner, F.lit("]}")).alias("tree"))


@query("""
SELECT CAST(s_nationkey AS BIGINT) AS unit, 'f' || s_suppkey AS name, CAST(s_suppkey AS BIGINT) AS line, CASE WHEN s_suppkey % 2 = 0 THEN 'internal' ELSE 'external' END AS linkage, s_suppkey % 3 <> 0 AS definition FROM supplier
""")
def function_rows(spark, sf_dir):
    """Declarations and definitions from node tables: a body is a node within a function's interval."""
    found = project.function_declarations(_unit_trees(spark, sf_dir), "s_nationkey", "tree")
    return found.select(F.col("unit").cast("long").alias("unit"), "name", "line", "linkage", "definition")


@query("""
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 7 = 0 THEN 'not-applicable' WHEN s_suppkey % 10 = 0 THEN 'ambiguous-target' ELSE 'found' END AS status FROM supplier
""")
def exact_nodes(spark, sf_dir):
    """Sums at exact places of the units; every seventh asks for a product."""
    n = F.col("s_suppkey").cast("long")
    asked = table(spark, sf_dir, "supplier").select("s_nationkey", n.alias("s_suppkey"), (n * 10).alias("target_start"), (n * 10 + 6).alias("target_end"), F.lit("BinaryOperator").alias("kind"), F.when(n % 7 == 0, "*").otherwise("+").alias("opcode"))
    return trees.exact_nodes(asked, trees.nodes(_unit_trees(spark, sf_dir), "s_nationkey", "tree"), "s_nationkey").select("s_suppkey", "status")


@query("""
WITH s AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 4 ELSE 2 END * CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS n FROM supplier)
SELECT CAST(s_nationkey AS BIGINT) AS unit, CAST(1 + sum(n) AS BIGINT) AS n_nodes, CAST(sum(n) AS BIGINT) AS last, CAST(max(CASE WHEN s_suppkey % 3 <> 0 THEN 3 ELSE 2 END) AS BIGINT) AS depth FROM s GROUP BY s_nationkey
""")
def tree_intervals(spark, sf_dir):
    rows = trees.nodes(_unit_trees(spark, sf_dir), "s_nationkey", "tree")
    return rows.groupBy(F.col("s_nationkey").cast("long").alias("unit")).agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.when(F.col("pre") == 0, F.col("last"))).alias("last"), F.max("depth").alias("depth"))


@query(f"""
WITH r AS (SELECT c_nationkey, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY c_nationkey)
SELECT 'nation=' || c_nationkey AS folder, size, {fnv(ascii_bytes("body"))} AS content_fingerprint FROM r
""")
def source_tree_files(spark, sf_dir):
    """Customers written as a tree of text files, a folder for each nation, and read back as a source tree."""
    at = scratch(spark)
    names = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name").repartition("nation").sortWithinPartitions("nation", "c_custkey")
    names.select("nation", "c_name").write.partitionBy("nation").text(at)
    rows = project.source_tree(spark, at, 1 << 30).where(F.col("path").endswith(".txt"))
    return rows.select(F.regexp_extract("path", r"\A[^/]*", 0).alias("folder"), "size", "content_fingerprint")


# --- parameters


def _schemas(spark, sf_dir):
    """Nations are parameters of their region's transformation: boolean, whole numbers up to their key, or their own name."""
    n = F.col("n_nationkey").cast("long")
    kind = F.when(n % 3 == 0, "boolean").when(n % 3 == 1, "integer").otherwise("choice")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t"), "n_regionkey").alias("transformation"), F.lit(1).alias("version"), F.col("n_name").alias("name"), kind.alias("kind"), (n % 2 == 0).alias("required"),
        F.lit(0).cast("long").alias("minimum"), n.alias("maximum"), F.array("n_name", F.lit("any")).alias("choices"), n.alias("n"),
    )


@query("""
SELECT 't' || n_regionkey AS transformation, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'false' WHEN n_nationkey % 3 = 1 THEN '0' ELSE n_name END AS value FROM nation
""")
def default_parameters(spark, sf_dir):
    out = recipes.default_values(_schemas(spark, sf_dir))
    return out.select("transformation", "name", F.coalesce(F.col("boolean_value").cast("string"), F.col("integer_value").cast("string"), "choice_value").alias("value"))


@query("""
WITH r AS (SELECT s_suppkey AS k, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
v AS (SELECT k, n_nationkey AS n, n_name AS name, n_nationkey % 3 AS kind, (k + n_nationkey) % 17 = 0 AS odd, (k * 7 + n_nationkey) % 23 = 0 AS twice, k % 30 AS i, CASE WHEN k % 4 = 0 THEN 'other' ELSE n_name END AS c, (k + n_nationkey) % 11 <> 0 AS there
      FROM r JOIN nation ON n_regionkey = r),
p AS (SELECT k, name, CASE WHEN NOT there THEN CASE WHEN n % 2 = 0 THEN 'missing' END WHEN twice THEN 'repeated' WHEN odd THEN 'kind' WHEN kind = 1 AND i > n THEN 'range' WHEN kind = 2 AND c = 'other' THEN 'choice' END AS problem FROM v),
q AS (SELECT * FROM p WHERE problem IS NOT NULL UNION ALL SELECT k, 'A unknown', 'unknown' FROM r WHERE k % 9 = 0)
SELECT CAST(k AS VARCHAR) AS recipe, min_by(name, name) AS parameter, min_by(problem, name) AS problem FROM q GROUP BY k
""")
def parameter_problems(spark, sf_dir):
    """A record for each supplier gives its region's parameters, some missing, repeated, of another kind, out of range or unknown."""
    k = F.col("s_suppkey").cast("long")
    nations = table(spark, sf_dir, "nation")
    records = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("k"), k.cast("string").alias("recipe"), F.lit("r").alias("identity"), F.concat(F.lit("t"), "n_regionkey").alias("transformation"), F.lit(1).alias("version"))
    schemas = _schemas(spark, sf_dir)
    k, n = F.col("k"), F.col("n")
    both = records.join(schemas.select("transformation", "name", "kind", "n"), "transformation").where((k + n) % 11 != 0)
    both = both.withColumn("_", F.explode(F.when((k * 7 + n) % 23 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    none = F.lit(None)
    given = both.select("recipe", "identity", "name", F.when((k + n) % 17 == 0, "text").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "boolean", True).alias("boolean_value"), F.when(F.col("kind") == "integer", k % 30).alias("integer_value"), F.when(F.col("kind") == "choice", F.when(k % 4 == 0, "other").otherwise(F.col("name"))).alias("choice_value"))
    odd = records.where(k % 9 == 0).select("recipe", "identity", F.lit("A unknown").alias("name"), F.lit("boolean").alias("kind"), F.lit(True).alias("boolean_value"), none.cast("long").alias("integer_value"), none.cast("string").alias("choice_value"))
    return recipes.parameter_problems(records, given.unionByName(odd), schemas).select("recipe", "parameter", "problem")
