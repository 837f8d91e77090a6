"""Column mappings: rename, wildcard, body pack, conversion, default, lookup, and computed columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.convert import coerce, convert
from riverbend.expr.compiler import Compiler
from riverbend.expr.syntax import parse
from riverbend.expr.values import Context, Value, to_json
from riverbend.operators.lookup import lookup

#: Most columns a wildcard expands to; fixed value.
WILDCARD_CAP = 4096


class MappingError(ValueError):
    """A mapping that does not fit its source or sink."""


@dataclass(frozen=True)
class Rule:
    """How one sink column is made: from a source column (``*`` for the whole row), or by an expression."""

    to: str
    source: str | None = None
    compute: str | None = None
    truncate: bool = False
    default: Any = None
    switch: tuple[tuple[str, Any], ...] = ()

    def __post_init__(self):
        if (self.compute is None) == (self.source is None):
            raise MappingError(f"{self.to}: give either a source column or an expression")
        if self.compute is not None and self.switch:
            raise MappingError(f"{self.to}: an expression takes no switch")
        if not self.to.strip():
            raise MappingError("a sink column has no name")


def rules(mapping: Mapping[str, Any], compute: Mapping[str, str] | None = None) -> list[Rule]:
    """Rules of configured tables: sink column to source column, or to a table of options; computed columns apart or within."""
    out = []
    for to, value in mapping.items():
        if isinstance(value, str):
            out.append(Rule(to, source=value))
            continue
        unknown = set(value) - {"from", "truncate", "default", "switch", "compute"}
        if unknown:
            raise MappingError(f"{to}: unknown options {sorted(unknown)}")
        out.append(Rule(to, value.get("from"), value.get("compute"), value.get("truncate", False), value.get("default"), tuple((value.get("switch") or {}).items())))
    for to, script in (compute or {}).items():
        if to in mapping:
            raise MappingError(f"{to} is declared twice")
        if to == "*":
            raise MappingError("an expression can't make the wildcard")
        out.append(Rule(to, compute=script))
    if not out:
        raise MappingError("the mapping is empty")
    wild = [r for r in out if r.to == "*"]
    packed = [r for r in out if r.source == "*" and r.to != "*"]
    if any(r.source != "*" for r in wild) or len(wild) > 1:
        raise MappingError("a wildcard is written '*' = '*', once")
    if wild and packed:
        raise MappingError("a wildcard and a packed row exclude each other")
    return out


def expand(given: list[Rule], source: Mapping[str, L.Type], sink: Mapping[str, tuple[L.Type, bool]] | None) -> list[Rule]:
    """Rules without the wildcard. It stands for the sink's other columns (nullable ones may lack a source), else for the source's."""
    out = [r for r in given if r.to != "*"]
    if len(out) == len(given):
        return out
    taken = {r.to for r in out}
    universe = list(sink if sink is not None else source)
    if len(universe) > WILDCARD_CAP:
        raise MappingError(f"the wildcard stands for over {WILDCARD_CAP} columns")
    wild = next(r for r in given if r.to == "*")
    for name in universe:
        if name in taken:
            continue
        if name in source:
            out.append(Rule(name, source=name, truncate=wild.truncate))
        elif not sink[name][1]:
            raise MappingError(f"{name} is not nullable and has no source column")
    return out


def source_types(df: DataFrame) -> dict[str, L.Type]:
    return {f.name: L.logical_type(f.dataType, f.metadata) for f in df.schema.fields}


def path(name: str, types: Mapping[str, L.Type]) -> Value:
    """A source column, or a dotted path into an object or JSON column."""
    if name in types:
        return Context(types).column(name)
    head, *rest = name.split(".")
    if head not in types or not rest:
        raise MappingError(f"unknown source column {name!r}")
    v = Context(types).column(head)
    for part in rest:
        if v.type.kind == "Json":
            v = Value(F.try_variant_get(v.col, f"$['{part}']", "variant"), L.JSON)
        elif v.type.kind == "Object" and part in dict(v.type.fields):
            v = Value(v.col.getField(part), dict(v.type.fields)[part])
        else:
            raise MappingError(f"unknown source column {name!r}")
    return v


def apply(df: DataFrame, given: list[Rule], sink: Mapping[str, tuple[L.Type, bool]] | None = None, context: Context | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One select: each rule's column, converted to the sink's type where the sink is known. ``keep`` passes hidden columns on.

    Everything is one projection, so Catalyst reads only the columns that rules name.
    """
    types = {n: t for n, t in source_types(df).items() if n not in keep}
    base = context or Context()
    ctx = Context(types, base.now, base.env, base.folder)
    compiler = Compiler(ctx)
    columns = []
    for r in expand(given, types, sink):
        want = sink[r.to][0] if sink is not None and r.to in sink else None
        if sink is not None and want is None:
            raise MappingError(f"the sink has no column {r.to!r}")
        columns.append(_column(r, want, types, compiler).alias(r.to))
    return df.select(*columns, *[F.col(k) for k in keep])


def _column(r: Rule, want: L.Type | None, types: Mapping[str, L.Type], compiler: Compiler):
    if r.compute is not None:
        v = compiler.compile(parse(r.compute))
        v = coerce(v, want, r.truncate) if want is not None else v
        return F.coalesce(v.col, F.lit(r.default).cast(L.spark_type(v.type))) if r.default is not None else v.col
    if r.source == "*":
        whole = Value(F.struct(*[F.col(f"`{n}`") for n in types]), L.object_of(*types.items()))
        return (convert(to_json(whole), want, True) if want is not None else to_json(whole)).col
    v = path(r.source, types)
    if r.switch:
        return lookup(v, dict(r.switch), r.default, want).col
    if want is None:
        return F.coalesce(v.col, F.lit(r.default).cast(L.spark_type(v.type))) if r.default is not None else v.col
    return convert(v, want, r.truncate, r.default).col
