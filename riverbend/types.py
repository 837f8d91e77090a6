"""Logical types, their Spark carriers, and the lossless and truncating conversion relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

INT_BITS = {"Int8": 8, "Int16": 16, "Int32": 32, "Int64": 64}
UINT_BITS = {"UInt8": 8, "UInt16": 16, "UInt32": 32, "UInt64": 64}
INTEGERS = {**INT_BITS, **UINT_BITS}
FLOATS = {"Float32": 24, "Float64": 53}  # bits of the mantissa
TAG = "logical"


@dataclass(frozen=True)
class Type:
    """kind, with the parameters that the kind has: bounds for Text and Bytes (size), Decimal (precision, scale), BigInt (width)."""

    kind: str
    size: int | None = None
    precision: int | None = None
    scale: int | None = None
    element: Type | None = None
    element_nullable: bool = True
    fields: tuple[tuple[str, Type], ...] = field(default=())

    def __str__(self) -> str:
        if self.kind == "Decimal" and self.precision is not None:
            return f"Decimal({self.precision},{self.scale})"
        if self.kind == "Array":
            return f"Array({self.element})"
        return f"{self.kind}({self.size})" if self.size is not None else self.kind

    @property
    def is_integer(self) -> bool:
        return self.kind in INTEGERS or self.kind == "BigInt"

    @property
    def is_float(self) -> bool:
        return self.kind in FLOATS

    @property
    def is_numeric(self) -> bool:
        return self.is_integer or self.is_float or self.kind == "Decimal"


BOOL, INT8, INT16, INT32, INT64 = (Type(k) for k in ("Bool", "Int8", "Int16", "Int32", "Int64"))
UINT8, UINT16, UINT32, UINT64 = (Type(k) for k in ("UInt8", "UInt16", "UInt32", "UInt64"))
FLOAT32, FLOAT64, BIGINT, DECIMAL = (Type(k) for k in ("Float32", "Float64", "BigInt", "Decimal"))
TEXT, BYTES, DATE, TIMESTAMP, UUID = (Type(k) for k in ("Text", "Bytes", "Date", "Timestamp", "Uuid"))
IPV4, IPV6, JSON, XML, INTERVAL, NULL = (Type(k) for k in ("Ipv4", "Ipv6", "Json", "Xml", "Interval", "Null"))
POLICY_DECIMAL = (38, 18)
SIMPLE = {t.kind: t for t in (BOOL, INT8, INT16, INT32, INT64, UINT8, UINT16, UINT32, UINT64, FLOAT32, FLOAT64, BIGINT, DECIMAL, TEXT, BYTES, DATE, TIMESTAMP, UUID, IPV4, IPV6, JSON, XML, INTERVAL, NULL)}


def array_of(element: Type, nullable: bool = True) -> Type:
    return Type("Array", element=element, element_nullable=nullable)


def object_of(*fields: tuple[str, Type]) -> Type:
    return Type("Object", fields=tuple(fields))


def decimal(precision: int, scale: int) -> Type:
    return Type("Decimal", precision=precision, scale=scale)


_CARRIERS: dict[str, T.DataType] = {
    "Bool": T.BooleanType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Text": T.StringType(), "Bytes": T.BinaryType(), "Date": T.DateType(),
    "Timestamp": T.TimestampType(), "Uuid": T.StringType(), "Ipv4": T.StringType(), "Ipv6": T.StringType(), "Json": T.VariantType(),
    "Xml": T.StringType(), "Union": T.VariantType(), "Interval": T.DayTimeIntervalType(), "Null": T.NullType(),
}


def spark_type(t: Type) -> T.DataType:
    if t.kind == "BigInt":
        return T.DecimalType(min(t.size or 38, 38), 0)
    if t.kind == "Decimal":
        return T.DecimalType(*((min(t.precision, 38), t.scale) if t.precision is not None else POLICY_DECIMAL))
    if t.kind == "Array":
        return T.ArrayType(spark_type(t.element), t.element_nullable)
    if t.kind == "Object":
        return T.StructType([T.StructField(n, spark_type(f)) for n, f in t.fields])
    return _CARRIERS[t.kind]


def logical_type(t: T.DataType, metadata: dict | None = None) -> Type:
    """The logical type of a Spark column; a tag in the field's metadata (see ``tagged``) wins over the carrier."""
    tag = (metadata or {}).get(TAG)
    if tag:
        return Type(tag, size=(metadata or {}).get("size"))
    plain = {
        T.BooleanType: BOOL, T.ByteType: INT8, T.ShortType: INT16, T.IntegerType: INT32, T.LongType: INT64, T.FloatType: FLOAT32, T.DoubleType: FLOAT64,
        T.BinaryType: BYTES, T.DateType: DATE, T.TimestampType: TIMESTAMP, T.TimestampNTZType: TIMESTAMP, T.VariantType: JSON, T.NullType: NULL, T.DayTimeIntervalType: INTERVAL,
    }
    if type(t) in plain:
        return plain[type(t)]
    if isinstance(t, (T.VarcharType, T.CharType)):
        return Type("Text", size=t.length)
    if isinstance(t, T.StringType):
        return TEXT
    if isinstance(t, T.DecimalType):
        return Type("BigInt", size=t.precision) if t.scale == 0 and (metadata or {}).get("bigint") else decimal(t.precision, t.scale)
    if isinstance(t, T.ArrayType):
        return array_of(logical_type(t.elementType), t.containsNull)
    if isinstance(t, T.StructType):
        return object_of(*[(f.name, logical_type(f.dataType, f.metadata)) for f in t.fields])
    if isinstance(t, T.MapType):
        return JSON
    raise TypeError(f"no logical type for {t}")


def tagged(name: str, t: Type, nullable: bool = True) -> T.StructField:
    """A Spark field that remembers a logical type its carrier can't tell."""
    meta = {TAG: t.kind} if t.kind in UINT_BITS or t.kind in ("Uuid", "Ipv4", "Ipv6", "Xml") else {"bigint": True} if t.kind == "BigInt" else {TAG: t.kind, "size": t.size} if t.size else {}
    return T.StructField(name, spark_type(t), nullable, meta)


CURSOR_KINDS = frozenset(k for k in SIMPLE if k not in ("Json", "Xml", "Interval", "Null"))

_DECIMAL_DIGITS = {8: 3, 16: 5, 32: 10, 64: 19}
_UINT_DIGITS = {8: 3, 16: 5, 32: 10, 64: 20}


def _fits_text(a: Type, b: Type, needed: int | None) -> bool:
    return b.size is None or (needed is not None and b.size >= needed)


def lossless(a: Type, b: Type) -> bool:
    """Whether every value of a keeps its meaning as a b."""
    ka, kb = a.kind, b.kind
    if ka == "Null" or (a == b):
        return True
    if ka in INT_BITS and kb in INT_BITS:
        return INT_BITS[ka] <= INT_BITS[kb]
    if ka in UINT_BITS and kb in UINT_BITS:
        return UINT_BITS[ka] <= UINT_BITS[kb]
    if ka in UINT_BITS and kb in INT_BITS:
        return UINT_BITS[ka] < INT_BITS[kb]
    if ka in INTEGERS and kb in FLOATS:
        return INTEGERS[ka] <= FLOATS[kb]
    if ka in INTEGERS and kb == "BigInt":
        return b.size is None or b.size >= (_DECIMAL_DIGITS if ka in INT_BITS else _UINT_DIGITS)[INTEGERS[ka]]
    if ka in INTEGERS and kb == "Decimal":
        return b.precision is None or b.precision - b.scale >= (_DECIMAL_DIGITS if ka in INT_BITS else _UINT_DIGITS)[INTEGERS[ka]]
    if ka == "BigInt" and kb == "BigInt":
        return b.size is None or (a.size is not None and a.size <= b.size)
    if ka == "BigInt" and kb == "Decimal":
        return b.precision is None or (a.size is not None and b.precision - b.scale >= a.size)
    if ka == "Float32" and kb == "Float64":
        return True
    if ka == "Decimal" and kb == "Decimal":
        return b.precision is None or (a.precision is not None and b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale)
    if (ka in INTEGERS and kb == "Bool") or (ka == "Bool" and kb in INTEGERS):
        return True
    if ka == kb and ka in ("Text", "Bytes"):
        return b.size is None or (a.size is not None and a.size <= b.size)
    if {ka, kb} == {"Uuid", "Text"}:
        return kb == "Uuid" or _fits_text(a, b, 36)
    if {ka, kb} == {"Uuid", "Bytes"}:
        return kb == "Uuid" or _fits_text(a, b, 16)
    if ka == "Text":
        return kb in ("Bool", "Xml", "Json", "Ipv4", "Ipv6")
    if ka in ("Ipv4", "Ipv6"):
        if kb == "Text":
            return _fits_text(a, b, 15 if ka == "Ipv4" else 45)
        if kb == "Bytes":
            return _fits_text(a, b, 4 if ka == "Ipv4" else 16)
        return ka == "Ipv4" and kb == "Ipv6"
    if ka == "Bytes" and kb in ("Ipv4", "Ipv6"):
        return True
    if ka in ("Object", "Array") and kb in ("Json", "Text"):
        return kb == "Json" or b.size is None
    if ka == "Array" and kb == "Array":
        return lossless(a.element, b.element) and (b.element_nullable or not a.element_nullable)
    if kb == "Text":
        return b.size is None
    return False


def convertible(a: Type, b: Type) -> bool:
    """Whether a turns into b when loss is allowed (``truncate``); a superset of ``lossless``."""
    ka, kb = a.kind, b.kind
    if lossless(a, b):
        return True
    if ka == "Date" and kb == "Timestamp":
        return False
    if a.is_numeric and b.is_numeric:
        return True
    if a.is_numeric and kb == "Bool":
        return True
    if ka == kb and ka in ("Text", "Bytes"):
        return True
    if kb == "Text" or (ka == "Timestamp" and kb == "Date"):
        return True
    return ka == "Ipv6" and kb == "Ipv4"


def union(a: Type, b: Type) -> Type:
    """The type of a value that is a or b (array elements, conditional branches)."""
    if a == b or b.kind == "Null":
        return a
    if a.kind == "Null":
        return b
    if a.is_integer and b.is_integer:
        if "BigInt" in (a.kind, b.kind) or "UInt64" in (a.kind, b.kind):
            return BIGINT
        return INT64
    if a.is_numeric and b.is_numeric:
        return DECIMAL if "Decimal" in (a.kind, b.kind) else FLOAT64
    if a.kind == b.kind and a.kind in ("Text", "Bytes"):
        return Type(a.kind)
    if a.kind == b.kind == "Array":
        return array_of(union(a.element, b.element))
    return JSON
