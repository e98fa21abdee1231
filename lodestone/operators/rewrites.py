"""Source rewrites backed by recorded facts about a syntax tree, and the facts of recorded trees.

A request names a transformation, its parameter and a target byte range of a
source.  Its facts say what the tree holds there: the form, the ranges of the
parts, types and what stands in the way.  rewrites() checks the facts against
the bytes and gives the replacement; tree_facts() reads them from recorded
trees in the JSON form that compilers dump (kind, range with offset and tokLen,
opcode, type, referencedDecl, inner).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import decimal_literal_value, interstitial_token, is_identifier, shift_of_power
from lodestone.sources.trees import nodes

# The transformations, the operators of an assignment and the contexts of a condition.
ASSIGNMENT, CONDITION, SHIFT = "assignment-to-compound", "double-negation-condition", "unsigned-multiply-to-shift"
OPERATORS = {"add": "+", "bitwise-and": "&", "bitwise-or": "|", "bitwise-xor": "^", "multiply": "*", "subtract": "-"}
CONTEXTS = ("do-while", "for", "if", "while")
# Forms that a transformation takes (the one that is already satisfied last), and the flags and ranges of facts.
FORMS = {
    ASSIGNMENT: ("assignment-binary", "assignment-compound"),
    CONDITION: ("double-negated-condition", "scalar-condition"),
    SHIFT: ("unsigned-multiply", "unsigned-shift"),
}
# Widths of unsigned types that every conforming compiler grants at least.
UNSIGNED_WIDTHS = {
    "unsigned char": 8, "unsigned short": 16, "unsigned short int": 16, "unsigned int": 16, "unsigned long": 32, "unsigned long int": 32, "unsigned long long": 64, "unsigned long long int": 64,
}
_FLAGS = (
    "contains_macro", "contains_comment", "contains_preprocessor", "language_extension", "alias_assumption", "ambiguous", "plain_identifier", "volatile", "type_matches", "unsigned", "scalar",
)
_RANGES = ("primary", "duplicate", "operand", "literal")
FACTS = (
    "form string, operator string, context string, "
    + ", ".join(f"{r}_start long, {r}_end long" for r in _RANGES)
    + ", literal_value decimal(20,0), width long, primary_declaration string, duplicate_declaration string, "
    + ", ".join(f"{f} boolean" for f in _FLAGS)
)
_FACT_NAMES = [c.split()[0] for c in FACTS.split(", ")]


def scan_status(target: Column) -> Column:
    """Null for bytes that a rewrite may touch; else what comes first: preprocessor, comment or extension."""
    first = F.regexp_extract(target, r"#|//|/\*|[^\x09\x0A\x0D\x20-\x7F]", 0)
    return F.when(first == "#", "unsupported-preprocessor").when(first.isin("//", "/*"), "unsupported-comment").when(first != "", "unsupported-extension")


def _c(name: str) -> Column:
    return F.col(name)


def _empty(part: str) -> Column:
    return (F.coalesce(_c(f"{part}_start"), F.lit(0)) == 0) & (F.coalesce(_c(f"{part}_end"), F.lit(0)) == 0)


def _inside(part: str) -> Column:
    s, e = _c(f"{part}_start"), _c(f"{part}_end")
    return F.coalesce((s < e) & (s >= _c("target_start")) & (e <= _c("target_end")), F.lit(False))


def _piece(start: Column, end: Column) -> Column:
    return F.expr("encode(source, 'utf-8')").substr((start + 1).cast("int"), (end - start).cast("int")).cast("string")


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _common_status() -> Column:
    """The first reason, in order, why no rewrite can be made at all."""
    forms = F.lit(False)
    for name, (before, after) in FORMS.items():
        forms = forms | ((_c("transformation") == name) & _c("form").isin(before, after))
    size = F.octet_length("source")
    return (
        F.when(~_yes((_c("target_start") >= 0) & (_c("target_start") < _c("target_end")) & (_c("target_end") <= size)), "facts-malformed")
        .when(~_c("transformation").isin(*FORMS), "catalogue-invalid")
        .when(~_yes(forms), "not-applicable")
        .when((_c("location_kind") != "spelling") | _yes(_c("contains_macro")), "unsupported-macro")
        .when(_yes(_c("contains_comment")), "unsupported-comment")
        .when(_yes(_c("contains_preprocessor")), "unsupported-preprocessor")
        .when(_yes(_c("language_extension")), "unsupported-extension")
        .when(_yes(_c("alias_assumption")), "unsupported-alias-assumption")
        .when(_yes(_c("ambiguous")), "ambiguous-target")
        .otherwise(scan_status(_piece(_c("target_start"), _c("target_end"))))
    )


def _assignment() -> tuple[Column, Column]:
    ts, te = _c("target_start"), _c("target_end")
    name, operand = _piece(_c("primary_start"), _c("primary_end")), _piece(_c("operand_start"), _c("operand_end"))
    again = _piece(_c("duplicate_start"), _c("duplicate_end"))
    fits = _yes(
        _c("parameter").isin(*OPERATORS) & (_c("operator") == _c("parameter")) & _c("context").isNull() & _c("plain_identifier") & ~_c("volatile") & _inside("primary") & _inside("operand")
        & _empty("literal") & (_c("primary_start") == ts) & (_c("operand_end") == te) & (_c("primary_start") < _c("operand_start")) & is_identifier(name) & _c("type_matches")
        & (F.length("primary_declaration") > 0)
    )
    token = F.lit(None).cast("string")
    between = _piece(_c("primary_end"), _c("operand_start"))
    joined, compound = F.lit(False), F.lit(False)
    middle = _piece(_c("duplicate_end"), _c("operand_start"))
    for word, sign in OPERATORS.items():
        mine = _c("parameter") == word
        token = F.when(mine, F.lit(sign)).otherwise(token)
        joined = joined | (mine & interstitial_token(middle, sign))
        compound = compound | (mine & interstitial_token(between, sign + "="))
    twice = _yes(
        _inside("duplicate") & (_c("primary_declaration") == _c("duplicate_declaration")) & (_c("primary_end") <= _c("duplicate_start")) & (_c("duplicate_end") <= _c("operand_start"))
        & interstitial_token(_piece(_c("primary_end"), _c("duplicate_start")), "=") & joined & (name == again)
    )
    done = _c("form") == "assignment-compound"
    status = (
        F.when(~fits, "not-applicable")
        .when(done, F.when(_yes(_empty("duplicate") & _c("duplicate_declaration").isNull() & compound), "already-satisfied").otherwise("facts-malformed"))
        .when(~twice, "not-applicable")
        .otherwise("edit")
    )
    return status, F.concat(name, F.lit(" "), token, F.lit("= "), operand)


def _condition() -> tuple[Column, Column]:
    ts, te = _c("target_start"), _c("target_end")
    fits = _yes(
        _c("parameter").isin(*CONTEXTS) & (_c("context") == _c("parameter")) & _c("operator").isNull() & _c("scalar") & ~_c("volatile") & _inside("operand") & _empty("primary")
        & _empty("duplicate") & _empty("literal") & _c("primary_declaration").isNull() & _c("duplicate_declaration").isNull()
    )
    whole = _yes((_c("operand_start") == ts) & (_c("operand_end") == te))
    twice = _yes((_c("operand_end") == te) & (ts < _c("operand_start")) & _piece(ts, _c("operand_start")).rlike(r"\A[ \t\r\n]*![ \t\r\n]*![ \t\r\n]*\z"))
    status = (
        F.when(~fits, "not-applicable")
        .when(_c("form") == "scalar-condition", F.when(whole, "already-satisfied").otherwise("facts-malformed"))
        .when(~twice, "facts-malformed")
        .otherwise("edit")
    )
    return status, _piece(_c("operand_start"), _c("operand_end"))


def _shift() -> tuple[Column, Column]:
    ts, te = _c("target_start"), _c("target_end")
    most = F.when(_c("parameter").rlike(r"\A[0-9]{1,2}\z"), _c("parameter")).cast("long")
    literal = decimal_literal_value(_piece(_c("literal_start"), _c("literal_end")))
    fits = _yes(
        most.between(1, 63) & _c("context").isNull() & _inside("primary") & _inside("literal") & _empty("duplicate") & _empty("operand") & (_c("primary_start") < _c("literal_start"))
        & ~_c("volatile") & _c("unsigned") & _c("type_matches") & _c("width").between(1, 64) & (literal == _c("literal_value"))
    )
    between = _piece(_c("primary_end"), _c("literal_start"))
    done = _c("form") == "unsigned-shift"
    paired = (_piece(ts, ts + 1) == "(") & (_piece(te - 1, te) == ")")
    shifted = _yes((_c("operator") == "shift-left") & paired & (_c("primary_start") == ts + 1) & (_c("literal_end") == te - 1) & (_c("literal_value") <= 63) & interstitial_token(between, "<<"))
    small = F.when(_c("literal_value") < F.lit(str(1 << 63)).cast("decimal(20,0)"), _c("literal_value").cast("long"))
    power = F.when(_c("literal_value") == F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(63).cast("long")).otherwise(shift_of_power(small))
    multiplied = _yes((_c("operator") == "multiply") & (_c("primary_start") == ts) & (_c("literal_end") == te) & interstitial_token(between, "*") & power.isNotNull())
    k = F.when(done, small).otherwise(power)
    status = (
        F.when(~fits | ~F.when(done, shifted).otherwise(multiplied), "not-applicable")
        .when(~_yes((k > 0) & (k < _c("width")) & (k <= most)), "not-applicable")
        .when(done, "already-satisfied")
        .otherwise("edit")
    )
    return status, F.concat(F.lit("("), _piece(_c("primary_start"), _c("primary_end")), F.lit(" << "), k.cast("string"), F.lit(")"))


def rewrites(requests: DataFrame, limit: int = 4096) -> DataFrame:
    """Adds status and replacement (null unless status is 'edit').

    requests: source, transformation, parameter, location_kind, target_start,
    target_end and the columns of FACTS.  status is 'edit', 'already-satisfied',
    or the first rule that the request breaks.  Offsets count bytes from 0, ends
    are exclusive; a replacement over `limit` bytes is refused.
    """
    bad = _common_status()
    status, replacement = F.lit("catalogue-invalid"), F.lit(None).cast("string")
    for name, rule in ((ASSIGNMENT, _assignment), (CONDITION, _condition), (SHIFT, _shift)):
        own, text = rule()
        status = F.when(_c("transformation") == name, own).otherwise(status)
        replacement = F.when(_c("transformation") == name, text).otherwise(replacement)
    rows = requests.withColumn("_bad", bad)
    rows = rows.withColumn("status", F.coalesce("_bad", F.when(F.col("_bad").isNull(), status)))
    rows = rows.withColumn("replacement", F.when(F.col("status") == "edit", replacement))
    over = F.octet_length("replacement") > limit
    rows = rows.withColumn("status", F.when(_yes(over), "resource-limit").otherwise(F.col("status")))
    return rows.withColumn("replacement", F.when(F.col("status") == "edit", F.col("replacement"))).drop("_bad")


# --- facts of recorded trees, as joins over node tables

_SIGN_NAMES = {sign: word for word, sign in OPERATORS.items()}
#: Statements, the place of their condition among their children, and its context.
_CONDITION_PLACE = {"IfStmt": (0, "if"), "WhileStmt": (0, "while"), "DoStmt": (1, "do-while"), "ForStmt": (2, "for")}
# A group for every piece of a target, white space too, so that the lengths of groups give all offsets.
_TWICE = r"(?s)\A([A-Za-z_]\w*)(\s*=\s*)([A-Za-z_]\w*)(\s*)([-+&|^*])(\s*)(.*?)\s*\z"
_COMPOUND = r"(?s)\A([A-Za-z_]\w*)(\s*)([-+&|^*])(=\s*)(.*?)\s*\z"
_SCALED = r"(?s)\A(\(?)([A-Za-z_]\w*)(\s*)(<<|\*)(\s*)([0-9]+[uUlL]*)\s*(\)?)\z"
_CONDITION = r"(?s)\A(\s*)(!!)?(\s*)(.*?)\s*\z"


def _group(pattern: str, k: int) -> Column:
    return F.regexp_extract("_said", pattern, k)


def _place(pattern: str, k: int) -> Column:
    """[start, end) of a group in the source, as an array."""
    start = _c("target_start")
    for i in range(1, k):
        start = start + F.length(_group(pattern, i))
    return F.array(start.cast("long"), (start + F.length(_group(pattern, k))).cast("long"))


def _questions(requests: DataFrame) -> DataFrame:
    """Adds what a request's own bytes say: shape (whether they ask for anything), form, sign, and its parts' places."""
    fits = _yes((_c("target_start") >= 0) & (_c("target_start") < _c("target_end")) & (_c("target_end") <= F.octet_length("source")))
    piece = F.substr(F.encode("source", "utf-8"), (_c("target_start") + 1).cast("int"), (_c("target_end") - _c("target_start")).cast("int"))
    rows = requests.withColumn("_fits", fits).withColumn("_said", F.when(fits, F.decode(piece, "iso-8859-1")).otherwise(""))  # a character for each byte
    t = _c("transformation")
    twice, compound, scaled = (_c("_said").rlike(p) for p in (_TWICE, _COMPOUND, _SCALED))
    opened = _group(_SCALED, 1) == "("
    by = lambda a, b, c: F.when(t == ASSIGNMENT, a).when(t == CONDITION, b).when(t == SHIFT, c)
    none = F.lit(None)
    shape = by(
        F.when(twice, (_group(_TWICE, 1) == _group(_TWICE, 3)) & (_group(_TWICE, 7) != "")).otherwise(compound & (_group(_COMPOUND, 5) != "")),
        _group(_CONDITION, 4) != "",
        scaled & (opened == (_group(_SCALED, 4) == "<<")) & (opened == (_group(_SCALED, 7) == ")")),
    )
    sign = by(F.when(twice, _group(_TWICE, 5)).otherwise(_group(_COMPOUND, 3)), none.cast("string"), _group(_SCALED, 4))
    second = by(F.when(twice, 0).otherwise(1), F.when(_group(_CONDITION, 2) != "", 0).otherwise(1), F.when(opened, 1).otherwise(0))
    form = F.lit(None).cast("string")
    for name, pair in FORMS.items():
        form = F.when(t == name, F.get(F.array(*map(F.lit, pair)), second)).otherwise(form)
    nowhere = none.cast("array<long>")
    rows = rows.withColumns({"_shape": _yes(shape), "form": form, "_sign": sign, "_inner": F.when(opened, 1).otherwise(0)})
    return rows.withColumns({
        "_primary": by(F.when(twice, _place(_TWICE, 1)).otherwise(_place(_COMPOUND, 1)), nowhere, _place(_SCALED, 2)),
        "_duplicate": by(F.when(twice, _place(_TWICE, 3)), nowhere, nowhere),
        "_operand": by(F.when(twice, _place(_TWICE, 7)).otherwise(_place(_COMPOUND, 5)), _place(_CONDITION, 4), nowhere),
        "_literal": by(nowhere, nowhere, _place(_SCALED, 6)),
        "literal_value": F.when(t == SHIFT, F.regexp_extract(_group(_SCALED, 6), r"\A[0-9]+", 0)).try_cast("decimal(20,0)"),
    })


def _wanted(rows: DataFrame) -> DataFrame:
    """A row for each node that a request asks for: _q, slot, place, and the kind and opcode it must have (null: any)."""
    t, sign = _c("transformation"), _c("_sign")
    whole = F.array(_c("target_start"), _c("target_end"))
    inner = F.array(_c("target_start") + _c("_inner"), _c("target_end") - _c("_inner"))
    text = F.lit(None).cast("string")
    slot = lambda name, place, kind, opcode: F.struct(F.lit(name).alias("slot"), place.alias("at"), kind.alias("kind"), opcode.alias("opcode"))
    binary = F.lit("BinaryOperator")
    twice = _c("form") == FORMS[ASSIGNMENT][0]
    root = F.when(t == ASSIGNMENT, slot("root", whole, F.when(twice, binary).otherwise("CompoundAssignOperator"), F.when(twice, "=").otherwise(F.concat(sign, F.lit("="))))).when(
        t == SHIFT, slot("root", inner, binary, sign)
    )
    root = F.when(t == CONDITION, slot("root", whole, text, text)).otherwise(root)
    reference = F.lit("DeclRefExpr")
    slots = [
        root, slot("primary", _c("_primary"), reference, text), slot("duplicate", _c("_duplicate"), reference, text),
        slot("right", F.array(F.get("_duplicate", F.lit(0)), F.get("_operand", F.lit(1))), binary, sign), slot("literal", _c("_literal"), F.lit("IntegerLiteral"), text),
    ]
    asked = rows.where(_c("_fits") & _c("_shape")).select("_q", "_unit", "transformation", F.explode(F.array(*slots)).alias("s"))
    return asked.select("_q", "_unit", "transformation", "s.slot", F.get("s.at", F.lit(0)).alias("_a"), F.get("s.at", F.lit(1)).alias("_b"), F.col("s.kind").alias("_k"), F.col("s.opcode").alias("_o")).where("_a is not null and _b is not null")


def _found(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(_q, and for each slot n_<slot> nodes, the first one in <slot>): nodes at the asked places, parts within the one root."""
    n = trees.select(F.col("_unit").alias("_u"), F.struct(*[c for c in trees.columns if c != "_unit"]).alias("node"), "start", "end", "kind", "opcode", "place", "parent_kind", "macro", "refers")
    wanted = _wanted(rows)
    condition = F.lit(False)
    for kind, (place, _) in _CONDITION_PLACE.items():
        condition = condition | ((F.col("parent_kind") == kind) & (F.col("place") == place))
    reference = F.col("_k") != "DeclRefExpr"
    fits = (F.col("_k").isNull() | (F.col("kind") == F.col("_k"))) & (F.col("_o").isNull() | (F.col("opcode") == F.col("_o")))
    fits = fits & ((F.col("transformation") != CONDITION) | _yes(condition)) & (F.coalesce(reference, F.lit(True)) | (~F.col("macro") & F.col("refers")))
    hits = wanted.join(n, (F.col("_unit") == F.col("_u")) & (F.col("_a") == F.col("start")) & (F.col("_b") == F.col("end"))).where(fits).select("_q", "slot", "node")
    root = hits.where("slot = 'root'").groupBy(F.col("_q").alias("_r")).agg(F.count(F.lit(1)).alias("n_root"), F.min_by("node", "node.pre").alias("root"))
    parts = hits.where("slot <> 'root'").join(root, F.col("_q") == F.col("_r")).where((F.col("node.pre") >= F.col("root.pre")) & (F.col("node.pre") <= F.col("root.last")))
    every = [x for s in ("primary", "duplicate", "right", "literal") for x in (F.count_if(F.col("slot") == s).alias(f"n_{s}"), F.min_by("node", F.when(F.col("slot") == s, F.col("node.pre"))).alias(s))]
    return root.join(parts.groupBy("_q").agg(*every), F.col("_r") == F.col("_q"), "left").drop("_q")


def tree_facts(requests: DataFrame) -> DataFrame:
    """Adds facts_status ('found' or why not) and the columns of FACTS to requests(source, transformation, target_start,
    target_end, tree, ...); the tree goes.

    Equal trees are read once, into a node table (sources.trees); nodes at the
    places that a request's bytes name are found by an equi-join on unit and
    place, and those below the request's root by their intervals.
    """
    kept = [c for c in requests.columns if c != "tree"]
    keyed = requests.withColumn("_unit", F.sha2(F.coalesce("tree", F.lit("")), 256))
    keyed = keyed.withColumn("_q", F.sha2(F.concat_ws("|", "_unit", F.sha2("source", 256), "transformation", "target_start", "target_end"), 256))
    trees = nodes(keyed.select("_unit", F.coalesce("tree", F.lit("")).alias("tree")).dropDuplicates(["_unit"]), "_unit", "tree")
    rows = _questions(keyed.drop("tree"))
    asked = rows.dropDuplicates(["_q"])
    broken = trees.where("pre = -1").select(F.col("_unit").alias("_broken"))
    rows = rows.join(_found(asked, trees), F.col("_q") == F.col("_r"), "left").join(broken, F.col("_unit") == F.col("_broken"), "left")
    t, double = _c("transformation"), _c("form") == FORMS[CONDITION][0]
    twice = _c("form") == FORMS[ASSIGNMENT][0]
    one = lambda slot: F.coalesce(F.col(f"n_{slot}"), F.lit(0)) == 1
    many = lambda slot: F.coalesce(F.col(f"n_{slot}"), F.lit(0)) > 1
    named = lambda slot: one(slot) & _yes((F.length(f"{slot}.ref_id") > 0) & (F.length(f"{slot}.ref_name") > 0) & (F.length(f"{slot}.ref_type") > 0))
    typed = F.col("root.type").isNotNull()
    negated = _yes((F.col("root.kind") == "UnaryOperator") & (F.col("root.opcode") == "!") & (F.col("root.first_kind") == "UnaryOperator") & (F.col("root.first_opcode") == "!"))
    width = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UNSIGNED_WIDTHS.items() for x in pair]), F.col("root.type")), F.lit(0))
    own = (
        F.when((t == ASSIGNMENT) & ~named("primary"), "facts-malformed")
        .when((t == ASSIGNMENT) & ~typed, "facts-malformed")
        .when((t == ASSIGNMENT) & twice & ~named("duplicate"), "facts-malformed")
        .when((t == ASSIGNMENT) & twice & many("right"), "ambiguous-target")
        .when((t == ASSIGNMENT) & twice & ~one("right"), "not-applicable")
        .when((t == ASSIGNMENT) & twice & (F.col("primary.ref_id") != F.col("duplicate.ref_id")), "not-applicable")
        .when((t == CONDITION) & double & ~negated, "not-applicable")
        .when((t == SHIFT) & ~named("primary"), "facts-malformed")
        .when((t == SHIFT) & many("literal"), "ambiguous-target")
        .when((t == SHIFT) & ~one("literal"), "not-applicable")
        .when((t == SHIFT) & ~typed, "facts-malformed")
        .when((t == SHIFT) & (width == 0), "not-applicable")
        .otherwise("found")
    )
    status = (
        F.when(~_yes(t.isin(*FORMS)), "catalogue-invalid")
        .when(~_c("_fits") | F.col("_broken").isNotNull(), "facts-malformed")
        .when(~_c("_shape"), "not-applicable")
        .when(many("root"), "ambiguous-target")
        .when(~one("root"), "not-applicable")
        .otherwise(own)
    )
    context = F.lit(None).cast("string")
    for kind, (_, word) in _CONDITION_PLACE.items():
        context = F.when(F.col("root.parent_kind") == kind, word).otherwise(context)
    words = F.create_map(*[F.lit(x) for pair in _SIGN_NAMES.items() for x in pair])
    same_types = lambda *columns: F.forall(F.array(*columns), lambda c: _yes(c == F.col("primary.ref_type")))
    declared = lambda slot: F.concat(F.lit("decl:"), F.col(f"{slot}.ref_id"))
    facts = {
        "form": _c("form"),
        "operator": F.when(t == ASSIGNMENT, F.try_element_at(words, _c("_sign"))).when(t == SHIFT, F.when(_c("_sign") == "<<", "shift-left").otherwise("multiply")),
        "context": F.when(t == CONDITION, context),
        "literal_value": _c("literal_value"),
        "width": F.when(t == SHIFT, width.cast("long")),
        "primary_declaration": F.when(t != CONDITION, declared("primary")),
        "duplicate_declaration": F.when(twice, declared("primary")),
        "contains_macro": F.col("root.has_macro"),
        "volatile": F.col("root.has_volatile"),
        "language_extension": F.col("root.has_extension"),
        "plain_identifier": t == ASSIGNMENT,
        "type_matches": F.when((t == ASSIGNMENT) & twice, same_types(F.col("root.type"), F.col("right.type"), F.col("duplicate.ref_type")))
        .when(t == ASSIGNMENT, same_types(F.col("root.type"), F.col("root.left_type"), F.col("root.result_type")))
        .when(t == SHIFT, same_types(F.col("root.type"))),
        "unsigned": t == SHIFT,
        "scalar": t == CONDITION,
    }
    for part in _RANGES:
        for k, side in enumerate(("start", "end")):
            facts[f"{part}_{side}"] = F.coalesce(F.get(f"_{part}", F.lit(k)), F.lit(0).cast("long"))
    kinds = {c.split()[0]: c.split()[1] for c in FACTS.split(", ")}
    blank = lambda name: F.lit(False) if kinds[name] == "boolean" else F.lit(None)
    value = lambda name: F.coalesce(facts.get(name, blank(name)), blank(name)) if kinds[name] == "boolean" else facts[name]
    out = rows.withColumn("facts_status", status)
    found = F.col("facts_status") == "found"
    return out.select(*kept, "facts_status", *[F.when(found, value(name)).cast(kinds[name]).alias(name) for name in _FACT_NAMES])
