"""Arrays, and lengths and parts of texts, bytes and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import INTS, MAX_ARRAY, MAX_TEXT, Context, Value, constant, function, guarded, need, wrong
from riverbend.functions.text import render


def length(name: str, x: Value) -> Column:
    kind = x.type.kind
    if kind == "Text":
        return F.char_length(x.col)
    if kind == "Bytes":
        return F.octet_length(x.col)
    if kind == "Array":
        return F.when(x.col.isNotNull(), F.size(x.col))
    if kind == "Object":
        return F.when(x.col.isNotNull(), F.lit(len(x.type.fields)))
    if kind == "Json":
        from riverbend.functions.json import json_length

        return json_length(x.col)
    raise wrong(name, x)


@function("len", 1)
def len_(_: Context, x: Value) -> Value:
    return Value(length("len", x).cast("bigint"), L.INT64)


@function("isEmpty", 1)
def is_empty(_: Context, x: Value) -> Value:
    return Value(length("isEmpty", x) == 0, L.BOOL)


@function("element", 2)
def element(_: Context, x: Value, i: Value) -> Value:
    """x[i]: negative counts from the end; out of range or a missing key is an error."""
    if x.type.kind == "Object":
        key = constant("element", need("element", i, "Text"))
        for n, t in x.type.fields:
            if n == key:
                return Value(x.col.getField(n), t)
        raise ExprError(f"the object has no key {key!r}")
    if x.type.kind == "Json":
        from riverbend.functions.json import json_element

        return json_element(x, i)
    if x.type.kind == "Text":
        at, n = need("element", i, *INTS).col.cast("bigint"), F.char_length(x.col)
        place = F.when(at < 0, at + n).otherwise(at)
        return Value(guarded((place < 0) | (place >= n), "IndexOutOfBounds", F.substr(x.col, (place + 1).cast("int"), F.lit(1)), L.TEXT), L.TEXT)
    if x.type.kind != "Array":
        raise wrong("element", x, i)
    at = need("element", i, *INTS).col.cast("bigint")
    n = F.size(x.col)
    place = F.when(at < 0, at + n).otherwise(at)
    return Value(guarded(x.col.isNotNull() & ((place < 0) | (place >= n)), "IndexOutOfBounds", F.get(x.col, place.cast("int")), x.type.element), x.type.element)


@function("arrayGet", 3)
def array_get(_: Context, x: Value, i: Value, default: Value) -> Value:
    """The default where the index is null or out of range; null for a null array."""
    x, i = need("arrayGet", x, "Array"), need("arrayGet", i, *INTS)
    t = L.union(x.type.element, default.type)
    at = i.col.cast("bigint")
    n = F.size(x.col)
    place = F.when(at < 0, at + n).otherwise(at)
    inside = F.coalesce((place >= 0) & (place < n), F.lit(False))
    got = F.when(inside, F.get(x.col, place.cast("int")).cast(L.spark_type(t))).otherwise(default.cast(t).col)
    return Value(F.when(x.col.isNotNull(), got), t)


@function("slice", 3)
def slice_(_: Context, x: Value, low: Value, high: Value) -> Value:
    """x[low:high]: negative bounds count from the end, null bounds are open, all are clamped."""
    if x.type.kind not in ("Text", "Bytes", "Array"):
        raise wrong("slice", x, low, high)
    n = length("slice", x)

    def bound(v: Value, default: Column) -> Column:
        if v.type.kind == "Null":
            return default
        at = need("slice", v, *INTS).col.cast("bigint")
        return F.coalesce(F.greatest(F.lit(0), F.least(F.when(at < 0, at + n).otherwise(at), n)), default)

    start, end = bound(low, F.lit(0)).cast("int"), bound(high, n).cast("int")
    size = F.greatest(end - start, F.lit(0))
    if x.type.kind == "Array":
        return Value(F.slice(x.col, start + 1, size), x.type)
    return Value(F.substr(x.col, start + 1, size), L.Type(x.type.kind))


@function("split", 2)
def split(_: Context, s: Value, sep: Value) -> Value:
    """By a literal separator, empty pieces kept; an empty separator gives characters."""
    s, sep = need("split", s, "Text"), need("split", sep, "Text")
    chars = F.filter(F.split(s.col, "", -1), lambda c: c != "")
    if sep.is_const and sep.const is not None:
        out = chars if not sep.const else F.split(s.col, "\\Q" + sep.const.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    else:
        quoted = F.concat(F.lit("\\Q"), F.replace(sep.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        out = F.when(sep.col == "", chars).otherwise(F.split(s.col, quoted, -1))
    t = L.array_of(L.TEXT, False)
    return Value(guarded(F.size(out) > MAX_ARRAY, "ArrayTooLarge", out, t), t)


@function("join", 2)
def join(_: Context, x: Value, sep: Value) -> Value:
    """Elements as text, null elements as empty text."""
    x, sep = need("join", x, "Array"), need("join", sep, "Text")
    element_type = x.type.element if x.type.element.kind != "Null" else L.TEXT
    parts = F.transform(x.cast(L.array_of(element_type)).col, lambda e: F.coalesce(render(Value(e, element_type)), F.lit("")))
    out = F.when(sep.col.isNotNull(), F.call_function("array_join", parts, sep.col))
    return Value(guarded(F.octet_length(out) > MAX_TEXT, "StringTooLarge", out, L.TEXT), L.TEXT)


@function("filterNotNull", 1)
def filter_not_null(_: Context, x: Value) -> Value:
    x = need("filterNotNull", x, "Array")
    return Value(F.array_compact(x.col), L.array_of(x.type.element, False))


