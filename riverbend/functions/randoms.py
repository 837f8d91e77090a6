"""Random values. A constant seed makes a value the same in every row and run; the stream is this engine's own."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import INTS, MAX_RANDOM_TEXT, MAX_TEXT, NUMERIC, Context, Value, constant, function, guarded, literal, need, unify

ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _seeded(seed: Value | None) -> random.Random | None:
    if seed is None:
        return None
    value = constant("a random function's seed", need("random", seed, *INTS))
    return None if value is None else random.Random(value)


def _null_seed(seed: Value | None) -> bool:
    return seed is not None and seed.is_const and seed.const is None


def _uuid_of(raw: bytes) -> str:
    h = (int.from_bytes(raw, "big") & ~(0xF << 76) | (4 << 76)) & ~(0x3 << 62) | (2 << 62)
    s = f"{h:032x}"
    return "-".join((s[:8], s[8:12], s[12:16], s[16:20], s[20:]))


@function("randomUuid", 0, 1)
def random_uuid(_: Context, seed: Value | None = None) -> Value:
    if _null_seed(seed):
        return Value(F.lit(None).cast("string"), L.UUID)
    draw = _seeded(seed)
    return Value(F.uuid() if draw is None else F.lit(_uuid_of(draw.randbytes(16))), L.UUID)


@function("randomInt", 2, 3)
def random_int(_: Context, low: Value, high: Value, seed: Value | None = None) -> Value:
    """Both bounds included."""
    a, b = (need("randomInt", v, *INTS).col.cast("bigint") for v in (low, high))
    draw = _seeded(seed)
    unit = F.rand() if draw is None else F.lit(draw.random())
    span = (b.cast("decimal(38,0)") - a.cast("decimal(38,0)") + 1).cast("double")
    return Value(guarded(a > b, "randomInt: the bounds are not in order", F.least(b, a + F.floor(unit * span).cast("bigint")), L.INT64), L.INT64)


@function("randomFloat", 2, 3)
def random_float(_: Context, low: Value, high: Value, seed: Value | None = None) -> Value:
    """The upper bound is excluded."""
    a, b = (need("randomFloat", v, *NUMERIC).col.cast("double") for v in (low, high))
    draw = _seeded(seed)
    unit = F.rand() if draw is None else F.lit(draw.random())
    return Value(guarded(a >= b, "randomFloat: the range is empty", a + unit * (b - a), L.FLOAT64), L.FLOAT64)


def _size(name: str, n: Value, most: int) -> int | None:
    size = constant(name, need(name, n, *INTS))
    if size is not None and not 0 <= size <= most:
        raise ExprError(f"{name}: the length must be 0 to {most}")
    return size


def _hex_digits(n: int) -> Column:
    """n random hexadecimal digits from version 4 UUIDs without their fixed digits."""
    if not n:
        return F.lit("")
    each = [F.regexp_replace(F.uuid(), r"^(.{8})-(.{4})-.(.{3})-.(.{3})-(.{12})$", "$1$2$3$4$5") for _ in range(-(-n // 30))]
    return F.substr(F.concat(*each), F.lit(1), F.lit(n))


@function("randomAlphanumeric", 1, 2)
def random_alphanumeric(_: Context, n: Value, seed: Value | None = None) -> Value:
    size, draw = _size("randomAlphanumeric", n, MAX_RANDOM_TEXT), _seeded(seed)
    if size is None or _null_seed(seed):
        return Value(F.lit(None).cast("string"), L.TEXT)
    return literal("".join(draw.choice(ALPHANUMERIC) for _ in range(size))) if draw else Value(F.randstr(size), L.TEXT)


@function("randomHex", 1, 2)
def random_hex(_: Context, n: Value, seed: Value | None = None) -> Value:
    size, draw = _size("randomHex", n, MAX_RANDOM_TEXT), _seeded(seed)
    if size is None or _null_seed(seed):
        return Value(F.lit(None).cast("string"), L.TEXT)
    return literal("".join(draw.choice("0123456789abcdef") for _ in range(size))) if draw else Value(_hex_digits(size), L.TEXT)


@function("randomBytes", 1, 2)
def random_bytes(_: Context, n: Value, seed: Value | None = None) -> Value:
    size, draw = _size("randomBytes", n, MAX_TEXT), _seeded(seed)
    if size is None or _null_seed(seed):
        return Value(F.lit(None).cast("binary"), L.BYTES)
    if draw:
        return literal(draw.randbytes(size))
    if size <= 240:
        return Value(F.unhex(_hex_digits(2 * size)), L.BYTES)

    def grow(seeds: pd.Series) -> pd.Series:
        return pd.Series([hashlib.shake_128(s.encode()).digest(size) for s in seeds])

    return Value(F.pandas_udf(grow, "binary")(F.concat(F.uuid(), F.uuid())), L.BYTES)


@function("randomChoice", 1, -1)
def random_choice(_: Context, *args: Value) -> Value:
    values, t = unify(list(args))
    return Value(F.get(F.array(*[v.col for v in values]), F.floor(F.rand() * len(values)).cast("int")), t)
