"""Facts of recorded trees by plain walks, one request at a time: what the joins over node tables are held against."""

from __future__ import annotations

import json
import re

from lodestone.operators.rewrites import _FLAGS, _RANGES, ASSIGNMENT, CONDITION, OPERATORS, SHIFT, UNSIGNED_WIDTHS

_SIGN_NAMES = {sign: word for word, sign in OPERATORS.items()}
_CONDITION_PLACE = {"IfStmt": (0, "if"), "WhileStmt": (0, "while"), "DoStmt": (1, "do-while"), "ForStmt": (2, "for")}


class _Refused(ValueError):
    """The request's status."""


def _nodes(tree):
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, dict) and "kind" in x:
            yield x
        if isinstance(x, dict):
            stack.extend(reversed(x.get("inner") or []))


def span(node: dict) -> tuple[int, int, bool] | None:
    """(start, end, whether it comes from a macro) of a node's bytes."""
    macro, places = False, []
    for side in ("begin", "end"):
        at = (node.get("range") or {}).get(side) or {}
        if "expansionLoc" in at or "spellingLoc" in at:
            macro, at = True, at.get("expansionLoc") or {}
        if "offset" not in at or "tokLen" not in at:
            return None
        places.append((at["offset"], at["tokLen"]))
    start, end = places[0][0], sum(places[1])
    return (start, end, macro) if start < end else None


def exact_node(tree: dict, target: tuple[int, int], kind: str, opcode: str | None = None) -> dict:
    """The one node of a kind (and opcode) that covers exactly the target."""
    hits = [n for n in _nodes(tree) if n["kind"] == kind and (opcode is None or n.get("opcode") == opcode) and (span(n) or ())[:2] == target]
    if len(hits) != 1:
        raise _Refused("ambiguous-target" if hits else "not-applicable")
    return hits[0]


def _reference(root: dict, target: tuple[int, int]) -> dict:
    """The declaration that the one reference at the target, below root, names."""
    hits = [n for n in _nodes(root) if n["kind"] == "DeclRefExpr" and span(n) == (*target, False) and isinstance(n.get("referencedDecl"), dict)]
    if len(hits) != 1:
        raise _Refused("facts-malformed")
    found = hits[0]["referencedDecl"]
    if not all(found.get(k) for k in ("id", "name")) or not _type(found):
        raise _Refused("facts-malformed")
    return found


def _type(node: dict, member: str = "type") -> str | None:
    return (node.get(member) or {}).get("qualType")


def _obstacles(node: dict) -> dict:
    said = json.dumps(node)
    macro = any((span(n) or (0, 0, False))[2] for n in _nodes(node)) or '"expansionLoc"' in said or '"spellingLoc"' in said
    return {"contains_macro": macro, "volatile": "volatile" in said, "language_extension": "__int128" in said or any(n["kind"] == "StmtExpr" for n in _nodes(node))}


_ASSIGN = re.compile(rb"([A-Za-z_]\w*)\s*(?:=\s*([A-Za-z_]\w*)\s*([-+&|^*])|([-+&|^*])=)\s*(.*?)\s*\Z", re.S | re.A)
_SCALED = re.compile(rb"(\()?([A-Za-z_]\w*)\s*(<<|\*)\s*([0-9]+[uUlL]*)\s*\)?\Z", re.S | re.A)


def _assignment_facts(source: bytes, target: tuple[int, int], tree: dict) -> dict:
    m = _ASSIGN.match(source[target[0] : target[1]])
    if not m or (m[2] is not None and m[2] != m[1]) or not m[5]:
        raise _Refused("not-applicable")
    at = lambda k: (target[0] + m.start(k), target[0] + m.end(k)) if m[k] is not None else None
    primary, duplicate, operand = at(1), at(2), at(5)
    sign = (m[3] or m[4]).decode()
    root = exact_node(tree, target, "BinaryOperator" if duplicate else "CompoundAssignOperator", "=" if duplicate else sign + "=")
    first = _reference(root, primary)
    kind = _type(root)
    if kind is None:
        raise _Refused("facts-malformed")
    if duplicate:
        second = _reference(root, duplicate)
        right = exact_node(root, (duplicate[0], operand[1]), "BinaryOperator", sign)
        if first["id"] != second["id"]:
            raise _Refused("not-applicable")
        types = [kind, _type(right), _type(second)]
    else:
        types = [kind, _type(root, "computeLHSType"), _type(root, "computeResultType")]
    name = f"decl:{first['id']}"
    return _obstacles(root) | {
        "form": "assignment-binary" if duplicate else "assignment-compound", "operator": _SIGN_NAMES[sign], "primary": primary, "duplicate": duplicate, "operand": operand,
        "primary_declaration": name, "duplicate_declaration": name if duplicate else None, "plain_identifier": True, "type_matches": all(t == _type(first) for t in types),
    }


def _condition_facts(source: bytes, target: tuple[int, int], tree: dict) -> dict:
    hits = []
    for n in _nodes(tree):
        place, context = _CONDITION_PLACE.get(n["kind"], (None, None))
        inner = n.get("inner") or []
        if place is not None and place < len(inner) and isinstance(inner[place], dict) and (span(inner[place]) or ())[:2] == target:
            hits.append((inner[place], context))
    text = source[target[0] : target[1]]
    start = target[0] + len(text) - len(text.lstrip())
    end = start + len(text.strip())
    double = source[start : start + 2] == b"!!" and start + 2 <= end
    first = start + 2 + len(source[start + 2 : end]) - len(source[start + 2 : end].lstrip()) if double else start
    if first >= end:
        raise _Refused("not-applicable")
    if len(hits) != 1:
        raise _Refused("ambiguous-target" if hits else "not-applicable")
    node, context = hits[0]
    is_not = lambda n: isinstance(n, dict) and n.get("kind") == "UnaryOperator" and n.get("opcode") == "!"
    if double and not (is_not(node) and is_not((node.get("inner") or [None])[0])):
        raise _Refused("not-applicable")
    return _obstacles(node) | {"form": "double-negated-condition" if double else "scalar-condition", "context": context, "operand": (first, end), "scalar": True}


def _shift_facts(source: bytes, target: tuple[int, int], tree: dict) -> dict:
    m = _SCALED.match(source[target[0] : target[1]])
    if not m or bool(m[1]) != (m[3] == b"<<") or bool(m[1]) != source[target[0] : target[1]].endswith(b")"):
        raise _Refused("not-applicable")
    inner = (target[0] + 1, target[1] - 1) if m[1] else target
    primary, literal = ((target[0] + m.start(k), target[0] + m.end(k)) for k in (2, 4))
    root = exact_node(tree, inner, "BinaryOperator", m[3].decode())
    first = _reference(root, primary)
    exact_node(root, literal, "IntegerLiteral")
    kind = _type(root)
    if kind is None:
        raise _Refused("facts-malformed")
    width = UNSIGNED_WIDTHS.get(kind, 0)
    if not width:
        raise _Refused("not-applicable")
    return _obstacles(root) | {
        "form": "unsigned-shift" if m[1] else "unsigned-multiply", "operator": "shift-left" if m[1] else "multiply", "primary": primary, "literal": literal,
        "literal_value": int(re.match(rb"[0-9]+", m[4])[0]), "width": width, "unsigned": True, "type_matches": kind == _type(first), "primary_declaration": f"decl:{first['id']}",
    }


_READERS = {ASSIGNMENT: _assignment_facts, CONDITION: _condition_facts, SHIFT: _shift_facts}


def facts_of(transformation: str, source: bytes, target: tuple[int, int], tree: str) -> tuple[str, dict]:
    """('found', facts) of one request, or its status and no facts."""
    reader = _READERS.get(transformation)
    if reader is None:
        return "catalogue-invalid", {}
    if not 0 <= target[0] < target[1] <= len(source):
        return "facts-malformed", {}
    try:
        found = reader(source, target, json.loads(tree))
    except _Refused as e:
        return str(e), {}
    except (ValueError, RecursionError):
        return "facts-malformed", {}
    row = {f: False for f in _FLAGS} | {k: v for k, v in found.items() if k not in _RANGES}
    for r in _RANGES:
        row[f"{r}_start"], row[f"{r}_end"] = found.get(r) or (0, 0)
    return "found", row




def function_rows(unit: str, tree: dict) -> list[tuple]:
    """(unit, name, file, line, column, linkage, definition) of every function declaration, the first of each place."""

    def body(x):
        return any(isinstance(c, dict) and (c.get("kind") == "CompoundStmt" or body(c)) for c in x.get("inner") or ())

    out: dict[tuple, tuple] = {}
    for x in _nodes(tree):
        if x.get("kind") == "FunctionDecl":
            at = x.get("loc", {})
            place = (unit, x.get("name"), at.get("file"), at.get("line"), at.get("col"))
            out.setdefault(place, ("internal" if x.get("storageClass") == "static" else "external", body(x)))
    return [k + v for k, v in out.items()]
