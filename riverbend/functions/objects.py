"""Objects: ordered keys with values."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.values import INTS, Context, Value, function, need, to_json, unify


def _fields(x: Value) -> list[tuple[str, Value]]:
    return [(n, Value(x.col.getField(n), t)) for n, t in x.type.fields]


@function("objectKeys", 2)
def object_keys(_: Context, x: Value, i: Value) -> Value:
    """The i-th key, counted from 0, else null."""
    i = need("objectKeys", i, *INTS)
    if x.type.kind == "Json":
        return Value(F.get(F.json_object_keys(F.to_json(x.col)), i.col.cast("int")), L.TEXT)
    x = need("objectKeys", x, "Object")
    keys = F.array(*[F.lit(n) for n, _t in x.type.fields]) if x.type.fields else F.array().cast("array<string>")
    return Value(F.when(x.col.isNotNull(), F.get(keys, i.col.cast("int"))), L.TEXT)


@function("objectValues", 2)
def object_values(_: Context, x: Value, i: Value) -> Value:
    """The i-th value, else null; values of several types come as JSON."""
    x, i = need("objectValues", x, "Object"), need("objectValues", i, *INTS)
    if i.is_const and isinstance(i.const, int):
        fields = _fields(x)
        return fields[i.const][1] if 0 <= i.const < len(fields) else Value(F.lit(None), L.NULL, None)
    values, t = unify([v for _n, v in _fields(x)])
    return Value(F.when(x.col.isNotNull(), F.get(F.array(*[v.col for v in values]), i.col.cast("int"))), t)


@function("objectHasKey", 2)
def object_has_key(_: Context, x: Value, key: Value) -> Value:
    key = need("objectHasKey", key, "Text")
    if x.type.kind == "Json":
        return Value(F.array_contains(F.json_object_keys(F.to_json(x.col)), key.col), L.BOOL)
    x = need("objectHasKey", x, "Object")
    return Value(F.when(x.col.isNotNull() & key.col.isNotNull(), key.col.isin(*[n for n, _t in x.type.fields]) if x.type.fields else F.lit(False)), L.BOOL)


@function("objectGet", 2)
def object_get(_: Context, x: Value, key: Value) -> Value:
    """The value of a key, else null."""
    key = need("objectGet", key, "Text")
    if x.type.kind == "Json":
        from riverbend.functions.json import member

        return member(x, key)
    x = need("objectGet", x, "Object")
    if key.is_const:
        return dict(_fields(x)).get(key.const, Value(F.lit(None), L.NULL, None))
    out = None
    values = [to_json(v) for _n, v in _fields(x)] if len({t for _n, t in x.type.fields}) > 1 else [v for _n, v in _fields(x)]
    for (n, _v), v in zip(_fields(x), values, strict=True):
        out = F.when(key.col == n, v.col) if out is None else out.when(key.col == n, v.col)
    return Value(out if out is not None else F.lit(None), values[0].type if values else L.NULL)
