"""Syntax tree of the expression language."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class ExprError(ValueError):
    """A program that can't be read or compiled; position is a character offset where known."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} (at {position})")
        self.position = position


@dataclass(frozen=True)
class Literal:
    value: Any  # int, float, bool, str, None or a Duration


@dataclass(frozen=True)
class Duration:
    micros: int


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    name: Node


@dataclass(frozen=True)
class Fields:
    names: tuple[str, ...] | None  # None: all


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Lazy:
    """if, multiIf, coalesce, ifNull, nullIf, &&, ||: arguments are evaluated only where needed."""

    kind: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Text:
    """An interpolated string: literal pieces and expressions."""

    parts: tuple[str | Node, ...]


@dataclass(frozen=True)
class Object:
    entries: tuple[tuple[Node, Node], ...]


@dataclass(frozen=True)
class Array:
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Block:
    bindings: tuple[tuple[str, Node], ...]
    result: Node


Node = Literal | Name | Field | Fields | Call | Lazy | Text | Object | Array | Block
