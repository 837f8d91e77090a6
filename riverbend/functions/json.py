"""JSON values, carried as VARIANT (which keeps keys in sorted order)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import INTS, Context, Value, constant, function, guarded, need, to_json
from riverbend.functions.outside import json_path_udf


@function("parseJson", 1)
def parse_json(_: Context, s: Value) -> Value:
    return Value(F.parse_json(need("parseJson", s, "Text").col), L.JSON)


@function("toJson", 1)
def to_json_(_: Context, v: Value) -> Value:
    return to_json(v)


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def _has(v: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(kind_of(v), F.lit(p))
    return F.coalesce(out, F.lit(False))


def json_length(v: Column) -> Column:
    """Elements of an array, keys of an object, characters of a text; any other JSON value is an error."""
    text = F.to_json(v)
    n = F.when(_has(v, "ARRAY"), F.json_array_length(text)).when(_has(v, "OBJECT"), F.size(F.json_object_keys(text)))
    n = n.when(_has(v, "STRING"), F.char_length(F.try_variant_get(v, "$", "string")))
    return F.when(v.isNotNull(), F.coalesce(n, F.raise_error(F.lit("len: the JSON value has no length")).cast("int")))


def _key_path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def member(x: Value, key: Value) -> Value:
    """The value of a key of a JSON object, else null."""
    if key.is_const:
        return Value(F.try_variant_get(x.col, _key_path(constant("objectGet", key)), "variant"), L.JSON)
    entries = F.try_variant_get(x.col, "$", "map<string,variant>")
    return Value(F.try_element_at(entries, key.col), L.JSON)


def json_element(x: Value, i: Value) -> Value:
    """x[i] of a JSON array or object; missing is an error."""
    if i.type.kind == "Text":
        got = member(x, i).col
        there = F.array_contains(F.json_object_keys(F.to_json(x.col)), i.col)
        return Value(guarded(x.col.isNotNull() & ~F.coalesce(there, F.lit(False)), "MissingKey", got, L.JSON), L.JSON)
    items = F.try_variant_get(x.col, "$", "array<variant>")
    at = need("element", i, *INTS).col.cast("bigint")
    n = F.size(items)
    place = F.when(at < 0, at + n).otherwise(at)
    bad = x.col.isNotNull() & (items.isNull() | (place < 0) | (place >= n))
    return Value(guarded(bad, "IndexOutOfBounds", F.get(items, place.cast("int")), L.JSON), L.JSON)


def json_contains(x: Value, y: Value) -> Value:
    """A key of an object, or an element of an array."""
    text = F.to_json(x.col)
    in_array = F.exists(F.try_variant_get(x.col, "$", "array<variant>"), lambda e: F.to_json(e) == F.to_json(to_json(y).col))
    in_object = F.array_contains(F.json_object_keys(text), y.col) if y.type.kind == "Text" else F.lit(False)
    found = F.when(_has(x.col, "OBJECT"), in_object).when(_has(x.col, "ARRAY"), in_array).otherwise(F.lit(False))
    return Value(F.when(x.col.isNotNull() & y.col.isNotNull(), found), L.BOOL)


_SIMPLE_PATH = re.compile(r"\$(?:\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\]|\['[^'\\]*'\]|\[\"[^\"\\]*\"\])*")


def _path(name: str, v: Value, path: Value) -> Column:
    """The first match as a variant. Member and index steps are built in; wildcards, slices and descent run in Arrow batches."""
    v = need(name, v, "Json")
    p = constant(name, need(name, path, "Text"))
    if p is None:
        return F.lit(None).cast("variant")
    if not p.startswith("$"):
        raise ExprError(f"{name}: a path begins with $")
    if _SIMPLE_PATH.fullmatch(p):
        return F.try_variant_get(v.col, p, "variant")
    return F.parse_json(json_path_udf(F.to_json(v.col), F.lit(p)))


@function("jsPath", 2)
def js_path(_: Context, v: Value, path: Value) -> Value:
    return Value(_path("jsPath", v, path), L.JSON)


def _typed(name: str, prefixes: tuple[str, ...], spark: str, t: L.Type) -> None:
    @function(name, 2)
    def compiled(_: Context, v: Value, path: Value) -> Value:
        """Only a value of the right JSON kind; others are null, never converted."""
        found = _path(name, v, path)
        ok = _has(found, *prefixes)
        if name == "jsPathInt":
            ok = ok & (F.try_variant_get(found, "$", "double") == F.floor(F.try_variant_get(found, "$", "double"))) & ~F.coalesce(F.contains(F.to_json(found), F.lit(".")), F.lit(False))
        return Value(F.when(ok, F.try_variant_get(found, "$", spark)), t)


_typed("jsPathString", ("STRING",), "string", L.TEXT)
_typed("jsPathInt", ("BIGINT", "DECIMAL"), "bigint", L.INT64)
_typed("jsPathFloat", ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "double", L.FLOAT64)
_typed("jsPathBool", ("BOOLEAN",), "boolean", L.BOOL)

