"""Value lookup: a table of source values and what they become; a miss or null gives the default or null."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.convert import ConversionError, parse_default
from riverbend.expr.values import Value
from riverbend.functions.text import render

SWITCHABLE = frozenset(("Bool", "Text", "Date", "Timestamp", "Uuid", "BigInt", *L.INTEGERS))


def _key(text: str, t: L.Type) -> str:
    """A configured key in the canonical text of the source's type."""
    if t.is_integer:
        return str(int(text))
    if t.kind == "Bool":
        if text.lower() not in ("true", "false"):
            raise ConversionError(f"switch key {text!r} is no Bool")
        return text.lower()
    return text.lower() if t.kind == "Uuid" else text


def _type_of(values: list[Any]) -> L.Type:
    kinds = {bool: L.BOOL, int: L.INT64, float: L.FLOAT64, str: L.TEXT}
    t = L.NULL
    for v in values:
        t = L.union(t, kinds.get(type(v), L.JSON))
    return t


def lookup(v: Value, cases: Mapping[str, Any], default: Any = None, want: L.Type | None = None) -> Value:
    """A literal map in the plan: for tables of configuration size."""
    if v.type.kind not in SWITCHABLE:
        raise ConversionError(f"{v.type} can't be switched on")
    if not cases:
        raise ConversionError("the switch has no cases")
    t = want or _type_of([*cases.values(), *([default] if default is not None else [])])
    keys: dict[str, Any] = {}
    for k, out in cases.items():
        key = _key(str(k), v.type)
        if key in keys:
            raise ConversionError(f"the switch has the key {key!r} twice")
        keys[key] = out
    table = F.create_map(*[x for k, out in keys.items() for x in (F.lit(k), parse_default(out, t))])
    found = F.try_element_at(table, render(v))
    hit = F.coalesce(F.map_contains_key(table, render(v)), F.lit(False))
    return Value(F.when(hit, found).otherwise(parse_default(default, t) if default is not None else F.lit(None).cast(L.spark_type(t))), t)


def lookup_table(df: DataFrame, column: str, table: DataFrame, key: str, value: str, default: Any = None, to: str | None = None) -> DataFrame:
    """The same against a table: an outer join, which Spark broadcasts within its size limit and splits where a key is frequent."""
    small = table.select(F.col(key).alias("__key"), F.col(value).alias("__value")).dropDuplicates(["__key"])
    joined = df.join(small, df[column] == F.col("__key"), "left")
    hit = F.coalesce(F.col("__value"), F.lit(default)) if default is not None else F.col("__value")
    return joined.withColumn(to or column, hit).drop("__key", "__value")
