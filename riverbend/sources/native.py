"""Native column types of the supported systems, as logical types.

Types that have no logical type of their own come in the carrier that keeps them whole: wide integers, symbols, hashes of places and
addresses with a mask as text, sketches and aggregate states as opaque bytes, maps, tuples and nested tables as JSON.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from riverbend import types as L


class NativeTypeError(ValueError):
    """A native type that is unknown, or known and refused."""


@dataclass(frozen=True)
class Parsed:
    name: str
    args: tuple[Parsed | str, ...] = ()


_PART = re.compile(r"\s*(?:([A-Za-z_][\w ]*?)\s*(?=[(),\[]|$)|(-?\d+|'(?:[^'\\]|\\.)*'(?:\s*=\s*-?\d+)?))")


def parse(text: str) -> Parsed:
    """Name(argument, ...), nested to any depth."""
    found, at = _parse(text, 0)
    if text[at:].strip() or isinstance(found, str):
        raise NativeTypeError(f"malformed type {text!r}")
    return found


def _parse(text: str, at: int) -> tuple[Parsed | str, int]:
    m = _PART.match(text, at)
    if not m:
        raise NativeTypeError(f"malformed type {text!r}")
    at = m.end()
    if m[2]:
        return m[2], at
    name, args = m[1].strip(), []
    if text[at:at + 1] == "(":
        at += 1
        while True:
            arg, at = _parse(text, at)
            args.append(arg)
            at += len(text[at:]) - len(text[at:].lstrip())
            if text[at:at + 1] == ",":
                at += 1
            elif text[at:at + 1] == ")":
                at += 1
                break
            else:
                raise NativeTypeError(f"malformed type {text!r}")
    return Parsed(name, tuple(args)), at


_INET, _OBJECT_ID = L.Type("Text", size=43), L.Type("Bytes", size=12)

# Names of types and what they become; fixed values.
POSTGRES = {
    "bool": L.BOOL, "boolean": L.BOOL, "int2": L.INT16, "smallint": L.INT16, "int4": L.INT32, "integer": L.INT32, "int": L.INT32, "int8": L.INT64, "bigint": L.INT64, "float4": L.FLOAT32, "real": L.FLOAT32, "float8": L.FLOAT64,
    "double precision": L.FLOAT64, "text": L.TEXT, "varchar": L.TEXT, "character varying": L.TEXT, "bpchar": L.TEXT, "character": L.TEXT, "char": L.TEXT, "bytea": L.BYTES, "date": L.DATE, "timestamptz": L.TIMESTAMP,
    "timestamp with time zone": L.TIMESTAMP, "uuid": L.UUID, "json": L.JSON, "jsonb": L.JSON, "numeric": L.DECIMAL, "decimal": L.DECIMAL, "xml": L.XML, "hll": L.BYTES, "inet": _INET,
}
MYSQL = {
    "tinyint": L.INT8, "smallint": L.INT16, "mediumint": L.INT32, "int": L.INT32, "integer": L.INT32, "bigint": L.INT64, "float": L.FLOAT32, "double": L.FLOAT64, "double precision": L.FLOAT64, "real": L.FLOAT64,
    "char": L.TEXT, "varchar": L.TEXT, "tinytext": L.Type("Text", size=255), "text": L.Type("Text", size=65_535), "mediumtext": L.Type("Text", size=16_777_215), "longtext": L.Type("Text", size=4_294_967_295),
    "binary": L.BYTES, "varbinary": L.BYTES, "tinyblob": L.Type("Bytes", size=255), "blob": L.Type("Bytes", size=65_535), "mediumblob": L.Type("Bytes", size=16_777_215), "longblob": L.Type("Bytes", size=4_294_967_295),
    "date": L.DATE, "timestamp": L.TIMESTAMP, "json": L.JSON, "uuid": L.UUID, "decimal": L.DECIMAL, "numeric": L.DECIMAL,
}
_UNSIGNED = {"tinyint": L.UINT8, "smallint": L.UINT16, "mediumint": L.UINT32, "int": L.UINT32, "integer": L.UINT32, "bigint": L.UINT64}
CLICKHOUSE = {
    "String": L.TEXT, "UUID": L.UUID, "Bool": L.BOOL, "Boolean": L.BOOL, "Date": L.DATE, "DateTime": L.TIMESTAMP, "Int8": L.INT8, "Int16": L.INT16, "Int32": L.INT32, "Int64": L.INT64, "UInt8": L.UINT8, "UInt16": L.UINT16, "UInt32": L.UINT32,
    "UInt64": L.UINT64, "Float32": L.FLOAT32, "Float64": L.FLOAT64, "JSON": L.JSON, "Object": L.JSON, "IPv4": L.IPV4, "IPv6": L.IPV6, "Int128": L.TEXT, "Int256": L.TEXT, "UInt128": L.TEXT, "UInt256": L.TEXT,
    "Enum8": L.TEXT, "Enum16": L.TEXT, "AggregateFunction": L.BYTES, "SimpleAggregateFunction": L.BYTES, "Map": L.JSON, "Tuple": L.JSON, "Nested": L.JSON,
}
_DECIMALS = {"Decimal32": 9, "Decimal64": 18, "Decimal128": 38, "Decimal256": 76}
QUESTDB = {
    "BOOLEAN": L.BOOL, "BYTE": L.INT8, "SHORT": L.INT16, "CHAR": L.Type("Text", size=1), "INT": L.INT32, "LONG": L.INT64, "FLOAT": L.FLOAT32, "DOUBLE": L.FLOAT64, "STRING": L.TEXT, "VARCHAR": L.TEXT, "SYMBOL": L.TEXT, "DATE": L.DATE,
    "TIMESTAMP": L.TIMESTAMP, "UUID": L.UUID, "BINARY": L.BYTES, "LONG256": L.Type("Text", size=66), "IPV4": L.IPV4, "GEOHASH": L.TEXT,
}
DOCUMENTS = {
    "double": L.FLOAT64, "string": L.TEXT, "object": L.JSON, "array": L.JSON, "binData": L.BYTES, "objectId": _OBJECT_ID, "bool": L.BOOL, "date": L.TIMESTAMP, "int": L.INT32, "long": L.INT64, "decimal": L.DECIMAL, "javascript": L.TEXT, "null": L.NULL,
}
# Known types without a faithful carrier, refused by name; fixed values.
REFUSED = {
    "postgres": ("timestamp", "timestamp without time zone", "cidr"), "mysql": ("datetime", "time", "year"),
    "clickhouse": ("Date32", "DateTime64", "Point", "Ring", "Polygon", "MultiPolygon", "LineString", "MultiLineString"),
}


def _numeric(precision: int | None, scale: int | None) -> L.Type:
    """A scale of 0 makes an integer of so many digits; no precision, an unbounded decimal."""
    if precision is None:
        return L.DECIMAL
    return L.decimal(precision, scale) if scale else L.Type("BigInt", size=precision)


def _numbers(p: Parsed) -> list[int]:
    return [int(a) for a in p.args if isinstance(a, str) and re.fullmatch(r"-?\d+", a)]


def logical(system: str, text: str) -> tuple[L.Type, bool | None]:
    """(logical type, nullable where the type itself says) of a native type's name."""
    kind = {"cockroachdb": "postgres", "mariadb": "mysql", "mongodb": "documents", "mongo-cdc": "documents"}.get(system, system)
    if kind == "postgres":
        return _postgres(text), None
    if kind == "mysql":
        return _mysql(text), None
    if kind == "clickhouse":
        return _clickhouse(parse(text))
    if kind == "questdb":
        return _questdb(text), None
    if kind == "documents" and text in DOCUMENTS:
        return DOCUMENTS[text], None
    raise NativeTypeError(f"{system}: unknown type {text!r}")


def _refuse(kind: str, name: str) -> None:
    if name in REFUSED.get(kind, ()):
        raise NativeTypeError(f"{kind}: the type {name!r} is not supported")


def _postgres(text: str) -> L.Type:
    name = text.strip().lower()
    if name.endswith("[]") or name.startswith("_"):
        element = _postgres(name[:-2] if name.endswith("[]") else name[1:])
        if element.kind in ("Json", "Xml", "Array"):
            raise NativeTypeError(f"postgres: arrays hold primitive values, not {element}")
        return L.array_of(element)
    p = parse(name)
    _refuse("postgres", p.name)
    if p.name not in POSTGRES:
        raise NativeTypeError(f"postgres: unknown type {text!r}")
    found, n = POSTGRES[p.name], _numbers(p)
    if found == L.DECIMAL:
        return _numeric(n[0] if n else None, n[1] if len(n) > 1 else None)
    return L.Type("Text", size=n[0]) if found == L.TEXT and n and p.name != "text" else found


def _mysql(text: str) -> L.Type:
    name = text.strip().lower()
    words = re.sub(r"\([^)]*\)", " ", name).split()
    unsigned = "unsigned" in words
    base = " ".join(w for w in words if w not in ("unsigned", "zerofill", "signed"))
    _refuse("mysql", base)
    if base not in MYSQL:
        raise NativeTypeError(f"mysql: unknown type {text!r}")
    n = [int(x) for x in re.findall(r"\d+", (re.search(r"\(([^)]*)\)", name) or ["", ""])[1])]
    if base == "tinyint" and n == [1]:
        return L.BOOL
    if unsigned and base in _UNSIGNED:
        return _UNSIGNED[base]
    found = MYSQL[base]
    if found == L.DECIMAL:
        return _numeric(n[0] if n else 10, n[1] if len(n) > 1 else 0)
    return L.Type(found.kind, size=n[0]) if found in (L.TEXT, L.BYTES) and n else found


def _clickhouse(p: Parsed) -> tuple[L.Type, bool | None]:
    if p.name == "Nullable":
        return _clickhouse(p.args[0])[0], True
    if p.name == "LowCardinality":
        return _clickhouse(p.args[0])
    _refuse("clickhouse", p.name)
    n = _numbers(p)
    if p.name in _DECIMALS:
        return L.decimal(_DECIMALS[p.name], n[0]), False
    if p.name == "Decimal":
        return L.decimal(*n), False
    if p.name == "FixedString":
        return L.Type("Bytes", size=n[0]), False
    if p.name == "Array":
        element, nullable = _clickhouse(p.args[0])
        return (L.JSON if element.kind in ("Array", "Json") else L.array_of(element, bool(nullable))), False
    if p.name not in CLICKHOUSE:
        raise NativeTypeError(f"clickhouse: unknown type {p.name!r}")
    return CLICKHOUSE[p.name], False


def _questdb(text: str) -> L.Type:
    head = text.strip().upper()
    if head == "DOUBLE[]":
        return L.array_of(L.FLOAT64, False)
    name = re.match(r"[A-Z0-9]+", head)
    if "[]" in head or not name or name[0] not in QUESTDB:
        raise NativeTypeError(f"questdb: unknown type {text!r}")
    if name[0] == "GEOHASH":
        bits = re.fullmatch(r"GEOHASH\((\d+)([BC])\)", head)
        width = int(bits[1]) * (5 if bits[2] == "C" else 1) if bits else 0
        if not 1 <= width <= 60:
            raise NativeTypeError(f"questdb: malformed type {text!r}")
    return QUESTDB[name[0]]
