"""Comparisons, null predicates and negation. Equality is total; ordering with a null or NaN is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.values import Context, Value, function, need, wrong


def _alike(name: str, a: Value, b: Value) -> tuple[Column, Column, bool]:
    """Both columns in a type that compares by value, and whether NaN can occur."""
    ka, kb = a.type.kind, b.type.kind
    if "Null" in (ka, kb):
        t = a.type if kb == "Null" else b.type
        return (a.col if ka != "Null" else a.null(t)), (b.col if kb != "Null" else b.null(t)), t.is_float
    if a.type.is_numeric and b.type.is_numeric:
        if a.type.is_float or b.type.is_float:
            return a.col.cast("double"), b.col.cast("double"), True
        return a.col, b.col, False
    if ka == kb or {ka, kb} <= {"Text", "Uuid", "Ipv4", "Ipv6", "Xml"}:
        if ka == "Json":
            return F.to_json(a.col), F.to_json(b.col), False
        return a.col, b.col, False
    raise wrong(name, a, b)


def _equal(name: str, a: Value, b: Value) -> Column:
    try:
        x, y, nan = _alike(name, a, b)
    except Exception:
        if a.type.kind in ("Object", "Array", "Json") or b.type.kind in ("Object", "Array", "Json"):
            return a.col.isNull() & b.col.isNull()
        raise
    same = x.eqNullSafe(y)
    return same & ~F.coalesce(F.isnan(x), F.lit(False)) if nan else same


@function("equals", 2)
def equals(_: Context, a: Value, b: Value) -> Value:
    return Value(_equal("equals", a, b), L.BOOL)


@function("notEquals", 2)
def not_equals(_: Context, a: Value, b: Value) -> Value:
    return Value(~_equal("notEquals", a, b), L.BOOL)


def _ordering(name: str, how) -> None:
    @function(name, 2)
    def compiled(_: Context, a: Value, b: Value) -> Value:
        if a.type.kind in ("Object", "Array", "Json") or b.type.kind in ("Object", "Array", "Json"):
            raise wrong(name, a, b)
        x, y, nan = _alike(name, a, b)
        out = how(x, y)
        if nan:
            out = out & ~F.isnan(x) & ~F.isnan(y)
        return Value(F.coalesce(out, F.lit(False)), L.BOOL)


_ordering("greater", lambda x, y: x > y)
_ordering("less", lambda x, y: x < y)
_ordering("greaterOrEquals", lambda x, y: x >= y)
_ordering("lessOrEquals", lambda x, y: x <= y)


@function("isNull", 1)
def is_null(_: Context, a: Value) -> Value:
    return Value(a.col.isNull(), L.BOOL)


@function("isNotNull", 1)
def is_not_null(_: Context, a: Value) -> Value:
    return Value(a.col.isNotNull(), L.BOOL)


@function("not", 1)
def negation(_: Context, a: Value) -> Value:
    return Value(~need("not", a, "Bool").col, L.BOOL)
