"""From syntax tree to column: one pass, types checked on the way; Catalyst does folding, pruning and code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.syntax import parse, parse_template
from riverbend.expr.tree import Array, Block, Call, ExprError, Field, Fields, Lazy, Literal, Name, Node, Object, Text
from riverbend.expr.values import Context, Value, call, constant, literal, need, to_json, unify

#: Cases of one multiIf over equals from which a lookup table is emitted.
LOOKUP_CASES = 8


class Compiler:
    def __init__(self, context: Context):
        import riverbend.functions  # noqa: F401  registers the functions

        self.context = context
        self.read: set[str] = set()

    def compile(self, node: Node, names: dict[str, Value] | None = None) -> Value:
        return getattr(self, f"_{type(node).__name__.lower()}")(node, names or {})

    def _literal(self, node: Literal, names: dict) -> Value:
        return literal(node.value)

    def _name(self, node: Name, names: dict) -> Value:
        if node.name not in names:
            raise ExprError(f"unknown variable {node.name}")
        return names[node.name]

    def _field(self, node: Field, names: dict) -> Value:
        name = constant("field", self.compile(node.name, names))
        self.read.add(name)
        return self.context.column(name)

    def _fields(self, node: Fields, names: dict) -> Value:
        chosen = list(self.context.fields) if node.names is None else list(node.names)
        self.read.update(chosen)
        return _object([(n, self.context.column(n)) for n in chosen])

    def _call(self, node: Call, names: dict) -> Value:
        return call(self.context, node.name, [self.compile(a, names) for a in node.args])

    def _block(self, node: Block, names: dict) -> Value:
        inner = dict(names)
        for name, value in node.bindings:
            inner[name] = self.compile(value, inner)
        return self.compile(node.result, inner)

    def _array(self, node: Array, names: dict) -> Value:
        items, t = unify([self.compile(i, names) for i in node.items])
        if not items:
            return Value(F.array(), L.array_of(L.NULL), items=())
        return Value(F.array(*[i.col for i in items]), L.array_of(t), items=tuple(items))

    def _object(self, node: Object, names: dict) -> Value:
        return _object([(constant("an object key", self.compile(k, names)), self.compile(v, names)) for k, v in node.entries])

    def _text(self, node: Text, names: dict) -> Value:
        from riverbend.functions.text import render

        parts = [F.lit(p) if isinstance(p, str) else F.coalesce(render(self.compile(p, names)), F.lit("")) for p in node.parts]
        return Value(F.concat(*parts), L.TEXT)

    def _lazy(self, node: Lazy, names: dict) -> Value:
        if node.kind == "multiIf" and (table := self._lookup(node, names)):
            return table
        args = [self.compile(a, names) for a in node.args]
        if node.kind in ("&&", "||"):
            a, b = (need(node.kind, x, "Bool") for x in args)
            return Value(a.col & b.col if node.kind == "&&" else a.col | b.col, L.BOOL)
        if node.kind == "nullIf":
            same = call(self.context, "equals", args)
            return Value(F.when(~same.col, args[0].col), args[0].type)
        if node.kind in ("coalesce", "ifNull"):
            values, t = unify(args)
            return Value(F.coalesce(*[v.col for v in values]), t)
        conditions = [need("a condition", c, "Bool") for c in args[:-1:2]]
        values, t = unify([*args[1::2], args[-1]])
        out = F.when(conditions[0].col, values[0].col)
        for c, v in zip(conditions[1:], values[1:-1], strict=True):
            out = out.when(c.col, v.col)
        return Value(out.otherwise(values[-1].col), t)

    def _lookup(self, node: Lazy, names: dict) -> Value | None:
        """A long multiIf that compares one value with constants becomes a map lookup; of equal keys the first counts."""
        cases = list(zip(node.args[:-1:2], node.args[1::2], strict=True))
        if len(cases) < LOOKUP_CASES:
            return None
        subject, keys = None, []
        for condition, value in cases:
            if not (isinstance(condition, Call) and condition.name == "equals" and isinstance(condition.args[1], Literal) and isinstance(value, Literal)):
                return None
            if subject is None:
                subject = condition.args[0]
            if condition.args[0] != subject or type(condition.args[1].value) not in (int, str):
                return None
            keys.append(condition.args[1].value)
        if len({type(k) for k in keys}) > 1:
            return None
        on = self.compile(subject, names)
        if not (on.type.kind == "Text" and isinstance(keys[0], str)) and not (on.type.kind in L.INT_BITS and isinstance(keys[0], int)):
            return None
        values, t = unify([literal(v.value) for _, v in cases] + [self.compile(node.args[-1], names)])
        first: dict = {}
        for k, v in zip(keys, values, strict=False):
            first.setdefault(k, v.col)
        key = on.col if on.type.kind == "Text" else on.col.cast("bigint")
        pairs = reduce(lambda out, kv: [*out, F.lit(kv[0]).cast("string" if isinstance(kv[0], str) else "bigint"), kv[1]], first.items(), [])
        table = F.create_map(*pairs)
        return Value(F.when(F.coalesce(F.map_contains_key(table, key), F.lit(False)), F.try_element_at(table, key)).otherwise(values[-1].col), t)


def _object(entries: list[tuple[str, Value]]) -> Value:
    last: dict[str, Value] = {}
    for name, value in entries:
        last[name] = value
    kept = [(n, to_json(v) if v.type == L.NULL else v) for n, v in last.items()]
    t = L.object_of(*[(n, v.type) for n, v in kept])
    return Value(F.struct(*[v.col.alias(n) for n, v in kept]), t, items=tuple(v for _, v in kept))


def compile_expression(source: str, context: Context) -> Value:
    return Compiler(context).compile(parse(source))


def compile_template(source: str, context: Context) -> Value:
    return Compiler(context).compile(parse_template(source))


def columns_read(source: str, context: Context) -> set[str]:
    compiler = Compiler(context)
    compiler.compile(parse(source))
    return compiler.read
