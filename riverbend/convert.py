"""Conversion of a typed column to another logical type, with loss only where it is allowed."""

from __future__ import annotations

import ipaddress
from typing import Any
from xml.parsers import expat

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import Value, fail, guarded, to_json
from riverbend.functions.casts import FALSE, FLOAT32_MAX, RANGES, TRUE, cut, cut_decimal, cut_float, trimmed, uuid_text
from riverbend.functions.outside import vectorised
from riverbend.functions.text import render


class ConversionError(ExprError):
    """The types don't convert, or only with loss that isn't allowed."""


def _xml(s: str) -> str:
    expat.ParserCreate().Parse(s, True)
    return s


def _ip(version: int):
    def read(s: str) -> str:
        a = ipaddress.ip_address(s.strip())
        if version == 6 and a.version == 4:
            return str(ipaddress.IPv6Address(f"::ffff:{a}"))
        if version == 4 and a.version == 6:
            if a.ipv4_mapped is None:
                raise ValueError(f"{s} is no mapped IPv4 address")
            return str(a.ipv4_mapped)
        return str(a)

    return read


_xml_udf = vectorised(object, "string", _xml)
_ip_udf = {4: vectorised(object, "string", _ip(4)), 6: vectorised(object, "string", _ip(6))}
_ip_bytes_udf = vectorised(object, "binary", lambda s: ipaddress.ip_address(s).packed)
_bytes_ip_udf = vectorised(object, "string", lambda b: str(ipaddress.ip_address(bytes(b))))


def _saturate(n: Column, kind: str) -> Column:
    lo, hi = (F.lit(str(x)).cast("decimal(38,0)") for x in RANGES[kind])
    return F.greatest(lo, F.least(hi, n))


def _integral(v: Value) -> Column:
    """The number without its fraction, as decimal(38,0); NaN is an error and infinities are clamped."""
    if v.type.is_float:
        x = F.greatest(F.lit(-1e37), F.least(F.lit(1e37), v.col.cast("double")))
        cut = F.when(x < 0, F.ceil(x.cast("decimal(38,1)"))).otherwise(F.floor(x.cast("decimal(38,1)"))).cast("decimal(38,0)")
        exact = F.when(F.abs(x) < 9.0e18, x.cast("bigint").cast("decimal(38,0)")).otherwise(x.cast("decimal(38,0)"))
        return F.when(F.isnan(v.col), fail("Overflow: not a number", L.BIGINT)).otherwise(F.when(F.abs(x) < 1e36, exact).otherwise(cut))
    if v.type.kind == "Decimal":
        return F.when(v.col < 0, F.ceil(v.col)).otherwise(F.floor(v.col)).cast("decimal(38,0)")
    return v.col.cast("decimal(38,0)")


def _to_integer(v: Value, t: L.Type) -> Column:
    if v.type.kind == "Bool":
        return v.col.cast("int").cast(L.spark_type(t))
    if L.lossless(v.type, t) and v.type.kind in L.INTEGERS:
        return v.col.cast(L.spark_type(t))
    if t.kind == "BigInt":
        n = _integral(v)
        most = 10 ** min(t.size or 38, 38) - 1
        return F.greatest(F.lit(str(-most)).cast("decimal(38,0)"), F.least(F.lit(str(most)).cast("decimal(38,0)"), n)).cast(L.spark_type(t))
    return _saturate(_integral(v), t.kind).cast(L.spark_type(t))


def _to_float(v: Value, t: L.Type) -> Column:
    x = v.col.cast("int").cast("double") if v.type.kind == "Bool" else v.col.cast("double")
    if t.kind == "Float32" and v.type.kind != "Float32":
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        x = F.when(odd, x).otherwise(F.greatest(F.lit(-FLOAT32_MAX), F.least(F.lit(FLOAT32_MAX), x)))
    return x.cast(L.spark_type(t))


def _to_decimal(v: Value, t: L.Type) -> Column:
    p, s = (t.precision, t.scale) if t.precision is not None else L.POLICY_DECIMAL
    if v.type.kind == "Decimal" and v.type.precision is not None and v.type.scale <= s:
        return v.col.cast(f"decimal({p},{s})")
    if v.type.is_integer:
        return v.col.cast(f"decimal({p},{s})")
    if v.type.is_float:
        return F.when(F.isnan(v.col) | (F.abs(v.col) == float("inf")), fail("Overflow: not a number", t)).otherwise(cut_float(v.col, p, s))
    if v.type.kind == "Decimal":
        return cut(v.col, p, s)
    return cut_decimal(v.col.cast("string"), p, s)


def convert(v: Value, t: L.Type, truncate: bool = False, default: Any = None) -> Value:
    """v as a t: losslessly, or with loss if truncate; null becomes the default."""
    if not (L.convertible(v.type, t) if truncate else L.lossless(v.type, t)):
        raise ConversionError(f"{v.type} does not convert to {t}" + ("" if truncate or not L.convertible(v.type, t) else " without truncate"))
    col = _convert(v, t)
    if default is not None:
        col = F.coalesce(col, parse_default(default, t))
    return Value(col, t)


def _convert(v: Value, t: L.Type) -> Column:
    a, b = v.type.kind, t.kind
    if a == "Null":
        return F.lit(None).cast(L.spark_type(t))
    if v.type == t:
        return v.col
    if b in L.INTEGERS or b == "BigInt":
        return _to_integer(v, t)
    if b in L.FLOATS:
        return _to_float(v, t)
    if b == "Decimal":
        return _to_decimal(v, t)
    if b == "Bool":
        if a == "Text":
            s = F.lower(trimmed(v.col))
            return F.when(s.isin(*TRUE), F.lit(True)).when(s.isin(*[x for x in FALSE if x]), F.lit(False)).when(s.isNotNull(), fail("not a boolean", L.BOOL))
        return v.col != 0
    if b == "Text":
        out = render(v)
        return F.substring(out, 1, t.size) if t.size is not None else out
    if b == "Bytes":
        if a == "Uuid":
            return F.unhex(F.replace(v.col, F.lit("-"), F.lit("")))
        if a in ("Ipv4", "Ipv6"):
            return _ip_bytes_udf(v.col)
        return F.substring(v.col, 1, t.size) if t.size is not None else v.col
    if b == "Uuid":
        if a == "Bytes":
            return guarded(F.octet_length(v.col) != 16, "a UUID has 16 bytes", uuid_text(F.hex(v.col)), L.UUID)
        return uuid_text(trimmed(v.col))
    if b in ("Ipv4", "Ipv6"):
        return _bytes_ip_udf(v.col) if a == "Bytes" else _ip_udf[int(b[-1])](v.col)
    if b == "Json":
        return F.parse_json(v.col) if a == "Text" else to_json(v).col
    if b == "Xml":
        return _xml_udf(v.col)
    if b == "Array":
        return F.transform(v.col, lambda e: _convert(Value(e, v.type.element), t.element))
    return v.col.cast(L.spark_type(t))


def parse_default(value: Any, t: L.Type) -> Column:
    """A configured literal as a t; bytes take a prefix hex:, base64:, utf8: or bin:."""
    if t.kind == "Bytes":
        form, _, body = str(value).partition(":")
        how = {"hex": bytes.fromhex, "base64": lambda s: __import__("base64").b64decode(s, validate=True), "utf8": str.encode, "bin": lambda s: int(s, 2).to_bytes(-(-len(s) // 8), "big")}.get(form)
        if how is None:
            raise ConversionError("a bytes literal begins with hex:, base64:, utf8: or bin:")
        return F.lit(how(body))
    if t.kind == "Json":
        import json

        return F.parse_json(F.lit(json.dumps(value)))
    if isinstance(value, bool) != (t.kind == "Bool"):
        raise ConversionError(f"{value!r} is no {t}")
    if t.kind in ("Text", "Uuid", "Xml", "Ipv4", "Ipv6") and not isinstance(value, str):
        raise ConversionError(f"{value!r} is no {t}")
    if t.is_numeric and not isinstance(value, (int, float, str)):
        raise ConversionError(f"{value!r} is no {t}")
    return F.lit(str(value) if t.kind in ("Decimal", "BigInt", "UInt64", "Date", "Timestamp") else value).cast(L.spark_type(t))


def coerce(v: Value, t: L.Type, truncate: bool = False) -> Value:
    """A computed value in its sink column's type: lossless, or narrowed where each value is in range, or with loss if allowed."""
    if truncate or L.lossless(v.type, t):
        return convert(v, t, truncate)
    if v.type.is_integer and t.kind in L.INTEGERS:
        n = v.col.cast("decimal(38,0)")
        lo, hi = (F.lit(str(x)).cast("decimal(38,0)") for x in RANGES[t.kind])
        return Value(guarded((n < lo) | (n > hi), f"the value is out of range of {t}", n.cast(L.spark_type(t)), t), t)
    if v.type.is_numeric and t.kind == "Decimal":
        return Value(v.col.cast(L.spark_type(t)), t)
    if v.type.is_numeric and t.is_float:
        return Value(v.col.cast(L.spark_type(t)), t)
    if v.type.kind == "Text" and t.kind == "Text":
        return Value(guarded(F.char_length(v.col) > t.size, "the text is too long", v.col, t), t)
    return convert(v, t, truncate)
