"""Keyset scans: rows after a cursor, in cursor order, at most a batch. Null is the smallest value.

A cursor field is a column, or a path of struct fields (a.b.c) where no column has that whole name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbend import types as L


class CursorError(ValueError):
    """A cursor that can't order its source."""


def column(name: str, columns: Sequence[str] = ()) -> Column:
    """The column of that name, else the struct field at that path."""
    return F.col(f"`{name}`") if name in columns or "." not in name else F.col(".".join(f"`{p}`" for p in name.split(".")))


def check(df: DataFrame, fields: Sequence[str]) -> None:
    for name in fields:
        try:
            found = df.select(column(name, df.columns)).schema.fields[0]
        except AnalysisException:
            raise CursorError(f"the cursor field {name!r} is not in the source") from None
        if L.logical_type(found.dataType, found.metadata).kind not in L.CURSOR_KINDS:
            raise CursorError(f"the cursor field {name!r} has no order")


def after(fields: Sequence[str], state: Sequence[Any], ascending: bool = True, columns: Sequence[str] = ()) -> Column:
    """Rows strictly after the state in lexicographic order. Equal prefixes compare null-safely; the first comparison is a plain range
    on the leading field, which reaches Parquet and JDBC scans as a pushed filter."""
    if len(fields) != len(state):
        raise CursorError("the cursor state does not fit its fields")

    def beyond(c: Column, value: Any) -> Column:
        if ascending:
            return c.isNotNull() if value is None else c > F.lit(value)
        return F.lit(False) if value is None else (c < F.lit(value)) | c.isNull()

    cols = [column(n, columns) for n in fields]
    terms = []
    for i, (c, value) in enumerate(zip(cols, state, strict=True)):
        same = [x.eqNullSafe(F.lit(v)) for x, v in zip(cols[:i], state[:i], strict=True)]
        terms.append(reduce(lambda a, b: a & b, [*same, beyond(c, value)]))
    out = reduce(lambda a, b: a | b, terms)
    if ascending and state[0] is not None:
        out = (cols[0] >= F.lit(state[0])) & out
    return out


def until(fields: Sequence[str], state: Sequence[Any], ascending: bool = True, columns: Sequence[str] = ()) -> Column:
    """Rows up to and with the state: those that are not after it. The range on an ascending leading field reaches scans as a pushed filter."""
    out = ~F.coalesce(after(fields, state, ascending, columns), F.lit(False))
    if ascending and state[0] is not None:
        first = column(fields[0], columns)
        out = ((first <= F.lit(state[0])) | first.isNull()) & out
    return out


def scan(df: DataFrame, fields: Sequence[str], state: Sequence[Any] | None = None, ascending: bool = True, limit: int | None = None) -> DataFrame:
    """The next batch: a distributed top-k with a limit; without one, everything after the state, unsorted."""
    check(df, fields)
    rows = df if state is None else df.where(after(fields, state, ascending, df.columns))
    if limit is None:
        return rows
    order = [column(f, df.columns).asc_nulls_first() if ascending else column(f, df.columns).desc_nulls_last() for f in fields]
    return rows.orderBy(*order).limit(limit)


def last(df: DataFrame, fields: Sequence[str], ascending: bool = True) -> tuple | None:
    """The cursor after a batch: its last row's fields, found without sorting; None for an empty batch."""
    key = F.struct(*[column(f, df.columns).alias(f"k{i}") for i, f in enumerate(fields)])
    row = df.agg((F.max if ascending else F.min)(key).alias("k")).first()
    return tuple(row["k"]) if row is not None and row["k"] is not None else None
