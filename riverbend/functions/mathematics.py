"""Functions of floats. Logarithms of zero and less give -inf and NaN, where Spark gives null."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.values import NUMERIC, Context, Value, function, guarded, need
from riverbend.functions.outside import vectorised


def number(name: str, v: Value) -> Column:
    return need(name, v, *NUMERIC).col.cast("double")


def _one(name: str, how) -> None:
    @function(name, 1)
    def compiled(_: Context, x: Value) -> Value:
        return Value(how(number(name, x)), L.FLOAT64)


def _log(how):
    return lambda x: F.when(F.isnan(x) | (x < 0), F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(how(x))


for _name, _how in (
    ("sin", F.sin), ("cos", F.cos), ("tan", F.tan), ("asin", F.asin), ("acos", F.acos), ("atan", F.atan), ("exp", F.exp), ("cbrt", F.cbrt), ("sinh", F.sinh), ("cosh", F.cosh), ("tanh", F.tanh),
    ("asinh", F.asinh), ("acosh", F.acosh), ("atanh", F.atanh), ("log", _log(F.ln)), ("log2", _log(F.log2)), ("log10", _log(F.log10)),
):
    _one(_name, _how)


@function("atan2", 2)
def atan2(_: Context, y: Value, x: Value) -> Value:
    return Value(F.atan2(number("atan2", y), number("atan2", x)), L.FLOAT64)


def _constant(name: str, value: float) -> None:
    @function(name, 0)
    def compiled(_: Context) -> Value:
        return Value(F.lit(value), L.FLOAT64, value)


for _name, _value in (("pi", math.pi), ("e", math.e), ("phi", (1 + math.sqrt(5)) / 2), ("tau", math.tau)):
    _constant(_name, _value)


def _gamma(x: float) -> float:
    if math.isnan(x) or x == -math.inf:
        return math.nan
    if x == 0:
        return math.copysign(math.inf, x)
    if x < 0 and x == math.floor(x):
        return math.nan
    try:
        return math.gamma(x)
    except OverflowError:
        return math.inf


def _ln_gamma(x: float) -> float:
    if math.isinf(x):
        return math.inf
    if x <= 0 and x == math.floor(x):
        return math.inf
    return math.lgamma(x)


def _sign_gamma(x: float) -> float:
    return -1.0 if x < 0 and math.floor(x) % 2 else 1.0


def _beta(a: float, b: float) -> float:
    if math.isnan(a) or math.isnan(b):
        return math.nan
    return _sign_gamma(a) * _sign_gamma(b) * _sign_gamma(a + b) * math.exp(_ln_gamma(a) + _ln_gamma(b) - _ln_gamma(a + b))


def _lambert(x: float) -> float:
    """Principal branch by Halley's method."""
    if math.isnan(x) or x < -1 / math.e:
        return math.nan
    if math.isinf(x) or x == 0:
        return x
    if x < -0.32:
        p = math.sqrt(max(0.0, 2 * (math.e * x + 1)))
        w = -1 + p - p * p / 3
    else:
        w = math.log1p(x) if x < 3 else math.log(x) - math.log(math.log(x))
    for _step in range(60):
        ew = math.exp(w)
        f = w * ew - x
        if w == -1:
            break
        step = f / (ew * (w + 1) - (w + 2) * f / (2 * w + 2))
        w -= step
        if abs(step) <= 1e-16 * (1 + abs(w)):
            break
    return w


_SPECIAL = {"erf": math.erf, "erfc": math.erfc, "gamma": _gamma, "lnGamma": _ln_gamma, "lambertW": _lambert}
for _name, _f in _SPECIAL.items():
    _one(_name, vectorised(np.float64, "double", _f))

_beta_udf = vectorised(np.float64, "double", _beta)


@function("beta", 2)
def beta(_: Context, a: Value, b: Value) -> Value:
    return Value(_beta_udf(number("beta", a), number("beta", b)), L.FLOAT64)


@function("isNaN", 1)
def is_nan(_: Context, x: Value) -> Value:
    col = number("isNaN", x)
    return Value(F.when(col.isNotNull(), F.isnan(col)), L.BOOL)


@function("isInfinite", 1)
def is_infinite(_: Context, x: Value) -> Value:
    return Value(F.abs(number("isInfinite", x)) == float("inf"), L.BOOL)


@function("clamp", 3)
def clamp(_: Context, x: Value, low: Value, high: Value) -> Value:
    v, a, b = (number("clamp", z) for z in (x, low, high))
    inside = F.when(v.isNull() | a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(v), v).otherwise(F.greatest(a, F.least(v, b)))
    return Value(guarded((a > b) | F.isnan(a) | F.isnan(b), "clamp: the bounds are not in order", inside, L.FLOAT64), L.FLOAT64)
