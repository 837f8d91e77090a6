"""Arithmetic: exact result types are chosen here, since Spark's own widening differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.values import NUMERIC, Context, Value, fail, function, guarded, need, unify, wrong


def pair(name: str, a: Value, b: Value) -> tuple[Value, Value]:
    return need(name, a, *NUMERIC), need(name, b, *NUMERIC)


def _exact(v: Value) -> Column:
    return v.col.cast("decimal(38,0)")


def operands(a: Value, b: Value, bits: int) -> tuple[Column, Column, L.Type, int | None]:
    """Both columns in the type of the result: Int64 while the bits suffice, then BigInt; Decimal before Float64 before integers."""
    if a.type.is_integer and b.type.is_integer:
        if bits <= 64:
            return a.col.cast("bigint"), b.col.cast("bigint"), L.INT64, bits
        return _exact(a), _exact(b), L.BIGINT, bits
    if "Decimal" in (a.type.kind, b.type.kind) and not (a.type.is_float or b.type.is_float):
        cols = [v.col if v.type.kind == "Decimal" else v.col.cast("decimal(20,0)") if v.type.kind != "BigInt" else _exact(v) for v in (a, b)]
        return cols[0], cols[1], L.DECIMAL, None
    return a.col.cast("double"), b.col.cast("double"), L.FLOAT64, None


@function("add", 2)
def add(_: Context, a: Value, b: Value) -> Value:
    if "Text" in (a.type.kind, b.type.kind):
        a, b = need("add", a, "Text"), need("add", b, "Text")
        return Value(F.concat(a.col, b.col), L.TEXT)
    if "Array" in (a.type.kind, b.type.kind):
        if a.type.kind != "Array" or b.type.kind != "Array":
            raise wrong("add", a, b)
        t = L.union(a.type, b.type)
        return Value(F.concat(a.cast(t).col, b.cast(t).col), t)
    a, b = pair("add", a, b)
    x, y, t, bits = operands(a, b, max(a.width, b.width) + 1)
    return Value(x + y, t, bits=bits)


@function("subtract", 2)
def subtract(_: Context, a: Value, b: Value) -> Value:
    a, b = pair("subtract", a, b)
    x, y, t, bits = operands(a, b, max(a.width, b.width) + 1)
    return Value(x - y, t, bits=bits)


@function("multiply", 2)
def multiply(_: Context, a: Value, b: Value) -> Value:
    a, b = pair("multiply", a, b)
    x, y, t, bits = operands(a, b, a.width + b.width)
    return Value(x * y, t, bits=bits)


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _nonzero(divisor: Column, quotient: Column, t: L.Type) -> Column:
    return guarded(divisor == 0, "DivisionByZero", quotient, t)


@function("divide", 2)
def divide(_: Context, a: Value, b: Value) -> Value:
    """Integers truncate toward zero; a zero divisor is an error for floats too."""
    a, b = pair("divide", a, b)
    x, y, t, bits = operands(a, b, a.width + 1 if a.width > 63 else a.width)
    if t == L.INT64:
        return Value(_nonzero(y, _div(x, y), t), t, bits=bits)
    if t == L.BIGINT:
        # Spark's integral division of decimals gives a bigint: a quotient beyond it is an error, not a wrong value.
        return Value(_nonzero(y, _div(x, y).cast("decimal(38,0)"), t), t, bits=bits)
    return Value(_nonzero(y, x / y, t), t)


@function("modulo", 2)
def modulo(_: Context, a: Value, b: Value) -> Value:
    """The sign follows the dividend."""
    a, b = pair("modulo", a, b)
    x, y, t, bits = operands(a, b, min(64, max(a.width, b.width)) if max(a.width, b.width) <= 64 else max(a.width, b.width))
    return Value(_nonzero(y, x % y, t), t, bits=bits)


@function("negate", 1)
def negate(_: Context, a: Value) -> Value:
    """Keeps the type; unsigned widens; the smallest Int64 is promoted."""
    a = need("negate", a, *NUMERIC)
    if a.type.kind == "UInt64" or (a.type.kind == "Int64" and a.width >= 64) or a.type.kind == "BigInt":
        return Value(-_exact(a), L.BIGINT)
    if a.type.is_integer:
        return Value(-a.col.cast("bigint"), L.INT64, bits=a.width + 1)
    return Value(-a.col, a.type)


@function("abs", 1)
def absolute(_: Context, a: Value) -> Value:
    a = need("abs", a, *NUMERIC)
    if a.type.kind in L.UINT_BITS:
        return a
    if a.type.kind == "BigInt" or (a.type.kind == "Int64" and a.width >= 64):
        return Value(F.abs(_exact(a)), L.BIGINT)
    if a.type.is_integer:
        return Value(F.abs(a.col.cast("bigint")), L.INT64, bits=a.width + 1)
    return Value(F.abs(a.col), a.type)


def _whole(name: str, how) -> None:
    @function(name, 1)
    def compiled(_: Context, a: Value) -> Value:
        a = need(name, a, *NUMERIC)
        if a.type.is_integer:
            return Value(a.col.cast("bigint"), L.INT64)
        col = how(a.col)
        if a.type.is_float:
            col = F.when(F.isnan(a.col) | (F.abs(a.col) >= 2.0 ** 63), fail("IntegerOverflow", L.FLOAT64)).otherwise(col.cast("double"))
        return Value(col.cast("bigint"), L.INT64)


_whole("ceil", F.ceil)
_whole("floor", F.floor)
# Half away from zero.
_whole("round", lambda c: F.signum(c) * F.floor(F.abs(c) + F.lit(0.5).cast("decimal(2,1)")))


def _extreme(name: str, pick, nan_wins) -> None:
    @function(name, 1, -1)
    def compiled(_: Context, *args: Value) -> Value:
        """Over arguments, not rows; nulls are skipped, NaN is kept."""
        for a in args:
            if a.type.kind not in (*NUMERIC, "Null", "Text", "Date", "Timestamp"):
                raise wrong(name, a)
        values, t = unify(list(args))
        cols = [v.col for v in values]
        best = pick(*cols) if len(cols) > 1 else cols[0]
        if t.is_float and nan_wins:
            any_nan = F.greatest(*[F.coalesce(F.isnan(c), F.lit(False)).cast("int") for c in cols], F.lit(0)) == 1
            best = F.when(any_nan, F.lit(float("nan")).cast(L.spark_type(t))).otherwise(best)
        return Value(best, t)


_extreme("min", F.least, True)
_extreme("max", F.greatest, False)


@function("sign", 1)
def sign(_: Context, a: Value) -> Value:
    a = need("sign", a, *NUMERIC)
    return Value(F.when(a.col > 0, F.lit(1)).when(a.col < 0, F.lit(-1)).when(a.col.isNotNull(), F.lit(0)).cast("bigint"), L.INT64, bits=2)


@function("power", 2)
def power(_: Context, a: Value, b: Value) -> Value:
    a, b = pair("power", a, b)
    return Value(F.pow(a.col.cast("double"), b.col.cast("double")), L.FLOAT64)


@function("sqrt", 1)
def sqrt(_: Context, a: Value) -> Value:
    return Value(F.sqrt(need("sqrt", a, *NUMERIC).col.cast("double")), L.FLOAT64)

