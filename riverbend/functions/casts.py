"""Explicit casts. Texts are trimmed and parsed; values out of range are errors, except where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import NUMERIC, Context, Value, constant, fail, function, guarded, need
from riverbend.functions.text import SPACE, _plain_float, render

RANGES = {k: (-(1 << (b - 1)), (1 << (b - 1)) - 1) for k, b in L.INT_BITS.items()} | {k: (0, (1 << b) - 1) for k, b in L.UINT_BITS.items()}
FLOAT32_MAX = 3.4028234663852886e38


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def whole(name: str, v: Value, lo: int, hi: int) -> Column:
    """The integer in a number, Bool or text as decimal(38,0), checked against the range."""
    v = need(name, v, *NUMERIC, "Bool", "Text")
    kind = v.type.kind
    if kind == "Bool":
        n = v.col.cast("int").cast("decimal(38,0)")
    elif kind == "Text":
        s = trimmed(v.col)
        n = guarded(~s.rlike(r"^[+-]?[0-9]+$"), f"{name}: not an integer", s.cast("decimal(38,0)"), L.BIGINT)
    elif v.type.is_float:
        x = v.col.cast("double")
        n = guarded(F.isnan(x) | (F.abs(x) >= 1e37), f"{name}: out of range", F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("decimal(38,0)") if hi > 1 << 62 else _truncated(x), L.BIGINT)
    elif kind == "Decimal":
        n = F.when(v.col < 0, F.ceil(v.col)).otherwise(F.floor(v.col)).cast("decimal(38,0)")
    else:
        n = v.col.cast("decimal(38,0)")
    low, high = F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")
    return guarded((n < low) | (n > high), f"{name}: out of range", n, L.BIGINT)


def _truncated(x: Column) -> Column:
    return F.when(F.abs(x) < 9.2e18, x.cast("bigint")).otherwise(F.lit(1 << 62)).cast("decimal(38,0)")


def _integer(name: str, t: L.Type) -> None:
    @function(name, 1)
    def compiled(_: Context, v: Value) -> Value:
        return Value(whole(name, v, *RANGES[t.kind]).cast(L.spark_type(t)), t)


for _name, _t in (("toInt8", L.INT8), ("toInt16", L.INT16), ("toInt32", L.INT32), ("toUInt8", L.UINT8), ("toUInt16", L.UINT16), ("toUInt32", L.UINT32), ("toUInt64", L.UINT64)):
    _integer(_name, _t)


@function("toInt64", 1)
def to_int64(_: Context, v: Value) -> Value:
    """A float is truncated and saturates; NaN is an error."""
    v = need("toInt64", v, *NUMERIC, "Bool", "Text")
    if v.type.is_float:
        x = v.col.cast("double")
        inside = F.when(x >= 2.0 ** 63, F.lit((1 << 63) - 1)).when(x <= -(2.0 ** 63), F.lit(-(1 << 63))).otherwise(F.when(F.abs(x) < 2.0 ** 63, x).cast("bigint"))
        return Value(guarded(F.isnan(x), "toInt64: not a number", inside, L.INT64), L.INT64)
    return Value(whole("toInt64", v, *RANGES["Int64"]).cast("bigint"), L.INT64)


@function("toBigInt", 1)
def to_big_int(_: Context, v: Value) -> Value:
    return Value(whole("toBigInt", v, -(10 ** 38 - 1), 10 ** 38 - 1), L.BIGINT)


def _float(name: str, v: Value) -> Column:
    v = need(name, v, *NUMERIC, "Bool", "Text")
    if v.type.kind == "Text":
        s = trimmed(v.col)
        return guarded(s.rlike(r"[dDfF]$"), f"{name}: not a number", s.cast("double"), L.FLOAT64)
    return v.col.cast("int").cast("double") if v.type.kind == "Bool" else v.col.cast("double")


@function("toFloat64", 1)
def to_float64(_: Context, v: Value) -> Value:
    return Value(_float("toFloat64", v), L.FLOAT64)


@function("toFloat32", 1)
def to_float32(_: Context, v: Value) -> Value:
    """Beyond the largest float it saturates; infinities and NaN stay."""
    x = _float("toFloat32", v)
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return Value(F.when(odd, x).otherwise(F.greatest(F.lit(-FLOAT32_MAX), F.least(F.lit(FLOAT32_MAX), x))).cast("float"), L.FLOAT32)


# Texts that are true and false; fixed values.
TRUE, FALSE = ("true", "1", "t", "y", "yes"), ("false", "0", "f", "n", "no", "")


@function("toBool", 1)
def to_bool(_: Context, v: Value) -> Value:
    """Any text that is not one of the false ones is true."""
    v = need("toBool", v, "Bool", *NUMERIC, "Text")
    if v.type.kind == "Bool":
        return v
    if v.type.kind == "Text":
        return Value(~F.lower(trimmed(v.col)).isin(*FALSE), L.BOOL)
    return Value(v.col != 0, L.BOOL)


@function("toDate", 1)
def to_date(_: Context, v: Value) -> Value:
    v = need("toDate", v, "Date", "Timestamp", "Text")
    if v.type.kind == "Text":
        s = trimmed(v.col)
        return Value(guarded(~s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "toDate: not a date", F.to_date(s, "yyyy-MM-dd"), L.DATE), L.DATE)
    return Value(v.col.cast("date"), L.DATE)


@function("toTimestamp", 1)
def to_timestamp(_: Context, v: Value) -> Value:
    """RFC 3339 text, Unix seconds, or a date at midnight UTC."""
    v = need("toTimestamp", v, "Timestamp", "Date", "Text", *L.INTEGERS)
    if v.type.kind == "Text":
        s = trimmed(v.col)
        bad = ~s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$")
        return Value(guarded(bad, "toTimestamp: not RFC 3339", F.upper(s).cast("timestamp"), L.TIMESTAMP), L.TIMESTAMP)
    return Value(F.timestamp_seconds(v.col.cast("bigint")) if v.type.is_integer else v.col.cast("timestamp"), L.TIMESTAMP)


def uuid_text(s: Column) -> Column:
    """Hyphenated, plain or braced to the canonical lower-case form."""
    digits = F.lower(F.regexp_replace(s, r"[{}-]", ""))
    ok = s.rlike(r"^(?:\{[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32})$")
    return guarded(~ok, "malformed UUID", F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), L.UUID)


@function("toUuid", 1)
def to_uuid(_: Context, v: Value) -> Value:
    v = need("toUuid", v, "Uuid", "Text")
    return v if v.type.kind == "Uuid" else Value(uuid_text(trimmed(v.col)), L.UUID)


@function("toDecimal", 3)
def to_decimal(_: Context, v: Value, precision: Value, scale: Value) -> Value:
    """Extra digits are cut, not rounded; too many integer digits are an error."""
    p, s = constant("toDecimal", precision), constant("toDecimal", scale)
    if not (isinstance(p, int) and isinstance(s, int)) or s > p or s < 0 or p < 1 or p > 38:
        raise ExprError("toDecimal takes a precision of 1 to 38 and a scale of at most that")
    v = need("toDecimal", v, *NUMERIC, "Text")
    t = L.decimal(p, s)
    if v.type.is_float:
        return Value(guarded(F.isnan(v.col) | (F.abs(v.col) == float("inf")), "toDecimal: not a decimal", cut_float(v.col, p, s), t), t)
    if v.type.kind == "Decimal" and v.type.precision is not None:
        return Value(cut(v.col, p, s), t)
    return Value(cut_decimal(trimmed(v.col) if v.type.kind == "Text" else render(v), p, s), t)


def cut(d: Column, p: int, s: int) -> Column:
    """A decimal as decimal(p, s), digits beyond s cut."""
    return F.when(d < 0, F.ceil(d, F.lit(s))).otherwise(F.floor(d, F.lit(s))).cast(f"decimal({p},{s})")


def cut_float(x: Column, p: int, s: int) -> Column:
    """A finite float's shortest decimal form as decimal(p, s), digits beyond s cut.

    That form has 17 digits at most, so a decimal of 38 digits holds it exactly if its scale follows the magnitude: 22 digits after the
    point from 1 to 1e15, and one at most beyond. Below 1 it may have more than 38, of which a scale over 20 could see a rounded one.
    """
    if s > 20:
        return cut_decimal(_plain_float(x), p, s)
    size, text = F.abs(x), x.cast("string")
    of = lambda scale: cut(text.cast(f"decimal(38,{scale})"), p, s)
    return F.when(size < 1, of(38)).when(size < 1e15, of(22)).when(size < 1e36, of(2)).otherwise(text.cast("decimal(38,0)").cast(f"decimal({p},{s})"))


def cut_decimal(text: Column, p: int, s: int) -> Column:
    """A plain decimal text as decimal(p, s), digits beyond s cut."""
    short = F.regexp_replace(text, rf"^([+-]?[0-9]*)(?:(\.[0-9]{{0,{s}}})[0-9]*)?$", "$1$2") if s else F.regexp_replace(text, r"^([+-]?[0-9]*)\.?[0-9]*$", "$1")
    short = F.when(short.rlike(r"^[+-]?\.?$"), F.concat(F.lit("0"))).otherwise(short)
    bad = ~text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(F.coalesce(bad, F.lit(False)), fail("toDecimal: not a decimal", L.decimal(p, s))).otherwise(short.cast(f"decimal({p},{s})"))


@function("toStringCast", 1)
def to_string_cast(_: Context, v: Value) -> Value:
    return Value(render(v), L.TEXT)
