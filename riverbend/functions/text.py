"""Text functions and the canonical rendering of every type as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.values import INTS, MAX_TEXT, Context, Value, constant, function, guarded, need, to_json, unify, wrong

#: White space of the Unicode White_Space property; fixed value.
SPACE = r"[\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _plain_float(x: Column) -> Column:
    """A float without exponent and without a trailing .0: 1, 0.1, 100000000000000000000, NaN, inf."""
    s = x.cast("string")
    named = F.when(s == "Infinity", F.lit("inf")).when(s == "-Infinity", F.lit("-inf"))
    return named.when(s.contains("E"), bound(s, _without_exponent)).otherwise(F.regexp_replace(s, r"\.0$", ""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without_exponent(s: Column) -> Column:
    """The plain form of a text like -1.25E-7: its digits, and where among them the point stands."""
    found = F.struct(
        F.regexp_extract(s, r"^(-?)", 1).alias("sign"), F.regexp_extract(s, r"^-?([0-9]+)", 1).alias("whole"), F.regexp_replace(F.regexp_extract(s, r"\.([0-9]+)E", 1), "0+$", "").alias("part"),
        F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int").alias("power"),
    )

    def placed(f: Column) -> Column:
        digits = F.concat(f["whole"], f["part"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -f["power"] - F.char_length(f["whole"])), digits)  # below 0.001 there is one whole digit
        return F.concat(f["sign"], F.when(f["power"] < 0, F.regexp_replace(small, "0+$", "")).otherwise(_shifted(f["whole"], f["part"], f["power"])))

    return bound(found, placed)


def _shifted(whole: Column, part: Column, power: Column) -> Column:
    long = F.char_length(part) > power
    inner = F.concat(whole, F.substr(part, F.lit(1), power), F.lit("."), F.substr(part, power + 1, F.char_length(part)))
    return F.when(long, inner).otherwise(F.concat(whole, F.rpad(part, power, "0")))


def _instant(x: Column) -> Column:
    """RFC 3339 with as many fraction digits (0, 3 or 6) as needed."""
    micros = F.pmod(F.unix_micros(x), F.lit(1_000_000))
    part = F.when(micros == 0, F.lit("")).when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def render(v: Value) -> Column:
    """The canonical text of a value; null stays null (interpolation turns it into an empty text)."""
    kind = v.type.kind
    if kind == "Text":
        return v.col
    if kind in L.FLOATS:
        return _plain_float(v.col)
    if kind == "Timestamp":
        return _instant(v.col)
    if kind == "Bytes":
        return F.lower(F.hex(v.col))
    if kind == "Json":
        return F.to_json(v.col)
    if kind in ("Object", "Array"):
        return F.to_json(to_json(v).col)
    if kind == "Interval":
        micros = (F.unix_micros(F.timestamp_seconds(F.lit(0)) + v.col)).cast("bigint")
        unit = [(1_000_000, "s"), (1000, "ms"), (1, "µs")]
        out = F.concat(_plain_float(micros / F.lit(float(unit[0][0]))), F.lit("s"))
        small = F.when(micros >= 1000, F.concat(_plain_float(micros / F.lit(1000.0)), F.lit("ms"))).otherwise(F.concat(micros.cast("string"), F.lit("µs")))
        return F.when((micros >= 1_000_000) | (micros == 0), out).otherwise(small)
    return v.col.cast("string")


def text(name: str, *values: Value) -> list[Value]:
    return [need(name, v, "Text") for v in values]


@function("concat", 1, -1)
def concat(_: Context, *args: Value) -> Value:
    if any(a.type.kind == "Array" for a in args):
        values, t = unify(list(args))
        if t.kind != "Array":
            raise wrong("concat", *args)
        return Value(F.concat(*[v.col for v in values]), t)
    return Value(F.concat(*[v.col for v in text("concat", *args)]), L.TEXT)


@function("charAt", 2)
def char_at(_: Context, s: Value, i: Value) -> Value:
    """Counted from 0; out of range is null."""
    s, i = need("charAt", s, "Text"), need("charAt", i, *INTS)
    at = i.col.cast("bigint")
    return Value(F.when((at >= 0) & (at < F.char_length(s.col)), F.substr(s.col, (at + 1).cast("int"), F.lit(1))), L.TEXT)


def _simple(name: str, how) -> None:
    @function(name, 1)
    def compiled(_: Context, s: Value) -> Value:
        return Value(how(need(name, s, "Text").col), L.TEXT)


_simple("upper", F.upper)
_simple("lower", F.lower)
_simple("trim", lambda c: F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""))


@function("replace", 3)
def replace(_: Context, s: Value, what: Value, by: Value) -> Value:
    """An empty pattern inserts between characters and at both ends."""
    s, what, by = text("replace", s, what, by)
    chars = F.split(s.col, "", -1)
    between = F.when(F.char_length(s.col) == 0, by.col).otherwise(F.concat(by.col, F.call_function("array_join", chars, by.col), by.col))
    plain = F.replace(s.col, what.col, by.col)
    if what.is_const and what.const:
        return Value(plain, L.TEXT)
    return Value(F.when(F.char_length(what.col) == 0, between).otherwise(plain), L.TEXT)


@function("startsWith", 2)
def starts_with(_: Context, s: Value, p: Value) -> Value:
    s, p = text("startsWith", s, p)
    return Value(F.startswith(s.col, p.col), L.BOOL)


@function("endsWith", 2)
def ends_with(_: Context, s: Value, p: Value) -> Value:
    s, p = text("endsWith", s, p)
    return Value(F.endswith(s.col, p.col), L.BOOL)


@function("contains", 2)
def contains(_: Context, x: Value, y: Value) -> Value:
    """A part of a text, an element of an array, a key of an object; the operator ``in`` with its sides turned."""
    kind = x.type.kind
    if kind in ("Text", "Null"):
        x, y = text("contains", x, y)
        return Value(F.contains(x.col, y.col), L.BOOL)
    if kind == "Array":
        if x.items is not None and x.items and all(i.is_const and i.const is not None for i in x.items):
            (*items, want), _t = unify([*x.items, y])
            return Value(want.col.isin(*[i.col for i in items]), L.BOOL)
        t = L.union(x.type.element, y.type)
        has = F.exists(x.cast(L.array_of(t)).col, lambda e: e.eqNullSafe(y.cast(t).col))
        return Value(F.when(x.col.isNotNull() & y.col.isNotNull(), has), L.BOOL)
    if kind == "Object":
        key = constant("contains", need("contains", y, "Text"))
        return Value(F.when(x.col.isNotNull(), F.lit(key in dict(x.type.fields))), L.BOOL)
    if kind == "Json":
        from riverbend.functions.json import json_contains

        return json_contains(x, y)
    raise wrong("contains", x, y)


@function("indexOf", 2)
def index_of(_: Context, x: Value, y: Value) -> Value:
    """Counted from 0; -1 when absent."""
    if x.type.kind == "Array":
        t = L.union(x.type.element, y.type)
        return Value((F.array_position(x.cast(L.array_of(t)).col, y.cast(t).col) - 1).cast("bigint"), L.INT64)
    x, y = text("indexOf", x, y)
    return Value((F.call_function("instr", x.col, y.col) - 1).cast("bigint"), L.INT64)


@function("format", 1, -1)
def format_(_: Context, template: Value, *args: Value) -> Value:
    """{0}, {1} ... are replaced in order; any null gives null."""
    out = need("format", template, "Text").col
    for i, a in enumerate(args):
        out = F.replace(out, F.lit("{%d}" % i), render(a))
    return Value(out, L.TEXT)


@function("toString", 1)
def to_string(_: Context, v: Value) -> Value:
    return Value(render(v), L.TEXT)


@function("reverse", 1)
def reverse(_: Context, x: Value) -> Value:
    if x.type.kind == "Array":
        return Value(F.reverse(x.col), x.type)
    return Value(F.reverse(need("reverse", x, "Text").col), L.TEXT)


@function("repeat", 2)
def repeat(_: Context, s: Value, n: Value) -> Value:
    s, n = need("repeat", s, "Text"), need("repeat", n, *INTS)
    times = F.greatest(n.col.cast("bigint"), F.lit(0).cast("bigint"))
    too_long = F.octet_length(s.col).cast("decimal(38,0)") * times > MAX_TEXT
    return Value(guarded(too_long, "StringTooLarge", F.repeat(s.col, F.least(times, F.lit(MAX_TEXT)).cast("int")), L.TEXT), L.TEXT)


def _pad(name: str, how) -> None:
    @function(name, 2, 3)
    def compiled(_: Context, s: Value, n: Value, pad: Value | None = None) -> Value:
        """Pads by the first character of pad; never cuts."""
        s, n = need(name, s, "Text"), need(name, n, *INTS)
        with_ = F.lit(" ") if pad is None else F.substr(need(name, pad, "Text").col, F.lit(1), F.lit(1))
        size = n.col.cast("bigint")
        padded = how(s.col, F.least(size, F.lit(MAX_TEXT)).cast("int"), with_)
        out = F.when(F.char_length(s.col) >= size, F.when(with_.isNotNull(), s.col)).otherwise(padded)
        return Value(guarded(size > MAX_TEXT, "StringTooLarge", out, L.TEXT), L.TEXT)


_pad("leftPad", F.lpad)
_pad("rightPad", F.rpad)


@function("regexMatch", 2)
def regex_match(_: Context, s: Value, p: Value) -> Value:
    s = need("regexMatch", s, "Text")
    return Value(F.rlike(s.col, F.lit(pattern("regexMatch", p))), L.BOOL)


@function("regexReplace", 3)
def regex_replace(_: Context, s: Value, p: Value, by: Value) -> Value:
    """All matches; $1, ${1} and ${name} refer to groups, $$ is a dollar."""
    s = need("regexReplace", s, "Text")
    return Value(F.regexp_replace(s.col, pattern("regexReplace", p), _replacement(constant("regexReplace", by))), L.TEXT)


def pattern(name: str, p: Value) -> str:
    """A constant pattern in the linear-time dialect: look-around and back references are refused."""
    import re

    from riverbend.expr.tree import ExprError

    found = constant(name, need(name, p, "Text"))
    if re.search(r"\(\?(?:[=!]|<[=!])", found) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", found) or "\\k<" in found:
        raise ExprError(f"{name}: look-around and back references are not supported")
    return re.sub(r"\(\?P<", "(?<", found)


def _replacement(by: str) -> str:
    """In the engine's form: $name takes the longest name; only numbers and names in braces are groups there."""
    import re

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "\\$"
        if m[0] == "\\":
            return "\\\\"
        name = m["a"] or m["b"]
        if name is None:
            return "\\$"
        return "${%s}" % name if not name.isdigit() else f"${name}"

    return re.sub(r"\$\$|\\|\$(?:\{(?P<a>\w+)\}|(?P<b>\w+))|\$", one, by)
