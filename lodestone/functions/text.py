"""Predicates and functions over paths, identifiers, literals, lines and JSON text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The control bytes, backslash and colon that a relative path must not hold.
_BAD_PATH = r"[\x00-\x1F\x7F\\:]"


def relative_path_valid(path: Column, limit: int = 4096) -> Column:
    """Not empty, within the limit, no leading or trailing slash, no empty, `.` or `..` part, no control, `\\` or `:`."""
    parts = F.split(path, "/")
    fine = F.forall(parts, lambda p: ~p.isin("", ".", ".."))
    return F.coalesce((F.octet_length(path).between(1, limit)) & ~path.rlike(_BAD_PATH) & fine, F.lit(False))


def text_valid(data: Column, limit: int) -> Column:
    """Binary data that is UTF-8 within the limit and has no NUL."""
    return F.coalesce((F.octet_length(data) <= limit) & F.is_valid_utf8(data.cast("string")) & (F.instr(F.hex(data), "00") % 2 != 1), F.lit(False))


def is_identifier(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def target_bytes_plain(x: Column) -> Column:
    """No `#`, no comment start, nothing outside printable ASCII and tab or line ends."""
    return F.coalesce(~x.rlike(r"#|//|/\*|[^\x09\x0A\x0D\x20-\x7E]"), F.lit(False))


def shift_of_power(x: Column) -> Column:
    """k where x = 2**k and x >= 2, else null."""
    return F.when((x >= 2) & (F.bit_count(x) == 1), F.round(F.log2(x.cast("double"))).cast("long"))


def decimal_literal_value(x: Column) -> Column:
    """The value of a decimal literal whose suffix is u, l, ll or both in any case (ll in one case), else null."""
    digits = F.regexp_extract(x, r"\A([0-9]+)([uU]?(l|L|ll|LL)?|(l|L|ll|LL)[uU])\z", 1)
    return F.when(digits != "", digits.cast("decimal(20,0)"))


def interstitial_token(x: Column, token: str) -> Column:
    """Only the token's bytes, in order, with blanks, line ends and parentheses anywhere between."""
    import re

    free = r"[ \t\r\n()]*"
    return x.rlike(r"\A" + free + free.join(re.escape(c) for c in token) + free + r"\z")


def line_count(x: Column) -> Column:
    """Line ends, and one more where the text goes on after the last."""
    ends = F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\n"), F.lit("")))
    return (ends + F.when((F.octet_length(x) > 0) & ~x.endswith("\n"), 1).otherwise(0)).cast("long")


def byte_offset(x: Column, line: Column, column: Column) -> Column:
    """0-based byte offset of a place (line and byte column count from 1); null where the text has no such place."""
    lines = F.split(x, "\n")
    before = F.aggregate(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, s: acc + F.octet_length(s) + 1)
    fits = (line >= 1) & (column >= 1) & (line <= F.size(lines)) & (column <= F.octet_length(F.get(lines, line - 1)) + 1)
    return F.when(fits, before + column - 1)


def record_name(position: Column) -> Column:
    return F.format_string("record-%06d", position)


def join_path(directory: Column, name: Column) -> Column:
    return F.when(name.startswith("/"), name).when(directory.endswith("/"), F.concat(directory, name)).otherwise(F.concat_ws("/", directory, name))


def normalize_path(path: Column, root: Column) -> Column:
    """An absolute path with `.` and `..` resolved, relative to root; null where it leaves the root."""

    def step(acc, p):
        return F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(F.lit("/"), F.array_join(parts, "/"))
    clean_root = F.rtrim(root, F.lit("/"))
    return F.when(whole.startswith(F.concat(clean_root, F.lit("/"))), F.substr(whole, F.length(clean_root) + 2))


def only_keys(json: Column, allowed: list[str]) -> Column:
    """A JSON object whose keys are all allowed (false for anything else)."""
    keys = F.json_object_keys(json)
    return F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0, F.lit(False))


def strict_long(text: Column) -> Column:
    """A whole number without sign, leading zeros or anything else, that fits a long; else null."""
    return F.when(text.rlike(r"\A(0|[1-9][0-9]*)\z"), F.try_to_number(text, F.lit("9" * 38)).cast("decimal(38,0)")).try_cast("long")


@F.pandas_udf(StringType())
def double_text(values: pd.Series) -> pd.Series:
    """17 significant digits, the evidence form of doubles."""
    return values.map(lambda v: format(v, ".17g"), na_action="ignore")


#: Levels of a strict document: the outermost value is level 0.
MAX_DEPTH = 64
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_LENIENT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def json_depth_over(document: Column, limit: int = MAX_DEPTH) -> Column:
    """Whether a well-formed document has a value below level `limit`: brackets and what lies between them are all that is read."""
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(document, _STRING, "s"), r"\s+", ""), r"[^\[\]{}]+", "s")
    start = F.struct(F.lit(0).alias("level"), F.lit(False).alias("over"))

    def step(at, mark):
        move = F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct((at["level"] + move).alias("level"), (at["over"] | ((move >= 0) & (at["level"] > limit))).alias("over"))

    # No value lies deeper than there are opening brackets: most documents need no second look.
    opened = F.length(F.regexp_replace(marks, r"[^\[{]", ""))
    return F.when(opened > limit, F.aggregate(F.split(marks, ""), start, step)["over"]).otherwise(False)


def strict_json_problem(document: Column) -> Column:
    """Null for a strict JSON document; else what is wrong: syntax (a null document and over 1000 levels too),
    duplicate-key, or depth (a value below level 64).

    Parsers stop after the first value, so the document is read as the one
    element of an array and as the one member of an object: nothing can follow
    a value in both.
    """
    array, member = F.concat(F.lit("["), document, F.lit("]")), F.concat(F.lit('{"v":'), document, F.lit("}"))
    formed = (F.size(F.from_json(array, "array<string>", _LENIENT)) == 1) & F.from_json(member, "v string, _corrupt_record string", _LENIENT)["_corrupt_record"].isNull()
    unique = F.try_parse_json(document).isNotNull()
    return F.when(~F.coalesce(formed, F.lit(False)), "syntax").when(~unique, "duplicate-key").when(json_depth_over(document), "depth")
