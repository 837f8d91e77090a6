"""Typed columns, and the registry of functions that map them to typed columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import Duration, ExprError

_UNSET = object()
#: Limits on values; fixed values.
MAX_TEXT, MAX_ARRAY, MAX_RANDOM_TEXT = 1 << 20, 100_000, 1024


@dataclass(frozen=True)
class Value:
    """A column with its logical type; ``const`` where the value is known when compiling, ``bits`` bounds integers."""

    col: Column
    type: L.Type
    const: Any = _UNSET
    bits: int | None = None
    items: tuple[Value, ...] | None = None

    @property
    def is_const(self) -> bool:
        return self.const is not _UNSET

    @property
    def width(self) -> int:
        if self.bits is not None:
            return self.bits
        return L.INTEGERS.get(self.type.kind, 128) + (self.type.kind in L.UINT_BITS)

    def cast(self, t: L.Type) -> Value:
        return self if self.type == t else Value(self.col.cast(L.spark_type(t)), t)

    def null(self, t: L.Type) -> Column:
        return F.lit(None).cast(L.spark_type(t))


def literal(value: Any) -> Value:
    if value is None:
        return Value(F.lit(None), L.NULL, None)
    if isinstance(value, bool):
        return Value(F.lit(value), L.BOOL, value)
    if isinstance(value, int):
        t = L.INT64 if -(1 << 63) <= value < 1 << 63 else L.BIGINT
        return Value(F.lit(value).cast(L.spark_type(t)), t, value, value.bit_length() + 1)
    if isinstance(value, float):
        return Value(F.lit(value), L.FLOAT64, value)
    if isinstance(value, str):
        return Value(F.lit(value), L.TEXT, value)
    if isinstance(value, bytes):
        return Value(F.lit(value), L.BYTES, value)
    if isinstance(value, Duration):
        return Value(F.lit(dt.timedelta(microseconds=value.micros)), L.INTERVAL, value)
    raise ExprError(f"no literal of {type(value).__name__}")


@dataclass
class Context:
    """What a program sees besides its arguments: the batch clock, environment, readable folder, and fields."""

    fields: Mapping[str, L.Type] = field(default_factory=dict)
    now: dt.datetime | None = None
    env: Mapping[str, str] = field(default_factory=dict)
    folder: str | None = None
    prefix: str = ""

    def clock(self) -> Column:
        """One instant per batch: bound by the runner, else the query's own timestamp."""
        return F.lit(self.now).cast("timestamp") if self.now is not None else F.current_timestamp()

    def column(self, name: str) -> Value:
        if name not in self.fields:
            raise ExprError(f"unknown column {name!r}")
        t = self.fields[name]
        quoted = ".".join(f"`{p}`" for p in ([self.prefix] if self.prefix else []) + [name])
        col = F.col(quoted)
        return Value(col.cast("timestamp") if t == L.TIMESTAMP else col, t)


Compile = Callable[..., Value]
REGISTRY: dict[str, tuple[int, int, Compile]] = {}


def function(name: str, least: int, most: int | None = None) -> Callable[[Compile], Compile]:
    """Registers a compiler(context, *values) for the arities least to most (most = -1: any number)."""

    def register(f: Compile) -> Compile:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (least, least if most is None else 1 << 30 if most < 0 else most, f)
        return f

    return register


def call(context: Context, name: str, args: list[Value]) -> Value:
    if name not in REGISTRY:
        raise ExprError(f"unknown function {name}")
    least, most, f = REGISTRY[name]
    if not least <= len(args) <= most:
        raise ExprError(f"{name} takes {least}{'' if least == most else f' to {most}' if most < 1 << 30 else ' or more'} arguments, not {len(args)}")
    return f(context, *args)


def wrong(name: str, *args: Value) -> ExprError:
    return ExprError(f"{name} does not take {', '.join(str(a.type) for a in args)}")


def need(name: str, value: Value, *kinds: str) -> Value:
    """value, if its kind is one of these; a null literal takes the first kind."""
    if value.type.kind == "Null":
        return Value(value.null(t := L.SIMPLE[kinds[0]]), t, None)
    if value.type.kind not in kinds:
        raise wrong(name, value)
    return value


INTS = ("Int64", "Int8", "Int16", "Int32", "UInt8", "UInt16", "UInt32", "UInt64", "BigInt")
NUMERIC = ("Float64", "Float32", "Decimal", *INTS)


def constant(name: str, value: Value) -> Any:
    if not value.is_const:
        raise ExprError(f"{name} takes a constant here")
    return value.const


def fail(message: str, t: L.Type) -> Column:
    return F.raise_error(F.lit(message)).cast(L.spark_type(t))


def guarded(bad: Column, message: str, good: Column, t: L.Type) -> Column:
    """good, but an error in rows where bad is true."""
    return F.when(F.coalesce(bad, F.lit(False)), fail(message, t)).otherwise(good)


def unify(values: list[Value]) -> tuple[list[Value], L.Type]:
    """The values cast to their common type."""
    t = L.NULL
    for v in values:
        t = L.union(t, v.type)
    out = []
    for v in values:
        if t == L.JSON and v.type not in (L.JSON, L.NULL):
            out.append(to_json(v))
        else:
            out.append(v.cast(t))
    return out, t


def to_json(v: Value) -> Value:
    """The value as JSON: objects and arrays by structure, other values by their JSON form."""
    kind = v.type.kind
    if kind == "Json":
        return v
    if kind in ("Object", "Array"):
        return Value(F.to_variant_object(v.col), L.JSON)
    if kind in ("Bool", "Text", "Float32", "Float64", "Decimal", *INTS):
        return Value(v.col.cast("variant"), L.JSON)
    from riverbend.functions.text import render

    return Value(render(v).cast("variant"), L.JSON)
