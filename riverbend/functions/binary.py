"""Bits of Int64, bytes, and their encodings as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import INTS, Context, Value, constant, function, guarded, need
from riverbend.functions.outside import decode_text_udf, encode_text_udf


def _bits(name: str, v: Value) -> Column:
    return need(name, v, "Int64", "Int8", "Int16", "Int32", "UInt8", "UInt16", "UInt32").col.cast("bigint")


def _two(name: str, how) -> None:
    @function(name, 2)
    def compiled(_: Context, a: Value, b: Value) -> Value:
        return Value(how(_bits(name, a), _bits(name, b)), L.INT64)


_two("bitAnd", lambda a, b: a.bitwiseAND(b))
_two("bitOr", lambda a, b: a.bitwiseOR(b))
_two("bitXor", lambda a, b: a.bitwiseXOR(b))


def _shift(name: str, sql: str) -> None:
    @function(name, 2)
    def compiled(_: Context, a: Value, n: Value) -> Value:
        by = _bits(name, n)
        return Value(guarded((by < 0) | (by > 63), "shift amount out of range", F.call_function(sql, _bits(name, a), by.cast("int")), L.INT64), L.INT64)


_shift("bitShiftLeft", "shiftleft")
_shift("bitShiftRight", "shiftright")


@function("bitNot", 1)
def bit_not(_: Context, a: Value) -> Value:
    return Value(F.bitwise_not(_bits("bitNot", a)), L.INT64)


@function("bitCount", 1)
def bit_count(_: Context, a: Value) -> Value:
    return Value(F.bit_count(_bits("bitCount", a)).cast("bigint"), L.INT64)


def raw(name: str, v: Value) -> Column:
    return need(name, v, "Bytes").col


@function("byteLength", 1)
def byte_length(_: Context, b: Value) -> Value:
    return Value(F.octet_length(raw("byteLength", b)).cast("bigint"), L.INT64)


@function("byteAt", 2)
def byte_at(_: Context, b: Value, i: Value) -> Value:
    """Counted from 0; out of range is null."""
    col, at = raw("byteAt", b), need("byteAt", i, *INTS).col.cast("bigint")
    one = F.conv(F.hex(F.substr(col, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return Value(F.when((at >= 0) & (at < F.octet_length(col)), one), L.INT64)


def _hex_bytes(s: Column) -> Column:
    bad = ~s.rlike("^(?:[0-9a-fA-F]{2})*$")
    return guarded(bad, "malformed hex", F.unhex(s), L.BYTES)


def _base64_bytes(s: Column, url: bool = False) -> Column:
    if url:
        ok = s.rlike("^[A-Za-z0-9_-]*$") & (F.char_length(s) % 4 != 1)
        return guarded(~ok, "malformed base64url", F.unbase64(F.translate(s, "-_", "+/")), L.BYTES)
    ok = s.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return guarded(~ok, "malformed base64", F.unbase64(s), L.BYTES)


def _base64(b: Column) -> Column:
    return F.regexp_replace(F.base64(b), r"\s", "")


def _base64_url(b: Column) -> Column:
    return F.regexp_replace(F.translate(_base64(b), "+/", "-_"), "=+$", "")


@function("bytesFromHex", 1)
def bytes_from_hex(_: Context, s: Value) -> Value:
    return Value(_hex_bytes(need("bytesFromHex", s, "Text").col), L.BYTES)


@function("bytesFromBase64", 1)
def bytes_from_base64(_: Context, s: Value) -> Value:
    return Value(_base64_bytes(need("bytesFromBase64", s, "Text").col), L.BYTES)


@function("bytesFromUtf8", 1)
def bytes_from_utf8(_: Context, s: Value) -> Value:
    return Value(need("bytesFromUtf8", s, "Text").col.cast("binary"), L.BYTES)


@function("hex", 1)
def hex_(_: Context, b: Value) -> Value:
    return Value(F.lower(F.hex(raw("hex", b))), L.TEXT)


@function("base64", 1)
def base64(_: Context, b: Value) -> Value:
    return Value(_base64(raw("base64", b)), L.TEXT)


@function("base64Url", 1)
def base64_url(_: Context, b: Value) -> Value:
    return Value(_base64_url(raw("base64Url", b)), L.TEXT)


@function("bytesEqual", 2)
def bytes_equal(_: Context, a: Value, b: Value) -> Value:
    return Value(raw("bytesEqual", a) == raw("bytesEqual", b), L.BOOL)


@function("urlEncode", 1)
def url_encode(_: Context, s: Value) -> Value:
    """Everything but letters, digits, - _ . ~ is escaped."""
    out = F.url_encode(need("urlEncode", s, "Text").col)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return Value(out, L.TEXT)


@function("urlDecode", 1)
def url_decode(_: Context, s: Value) -> Value:
    """A plus stays a plus."""
    return Value(F.url_decode(F.replace(need("urlDecode", s, "Text").col, F.lit("+"), F.lit("%2B"))), L.TEXT)


@function("encode", 2)
def encode(_: Context, b: Value, form: Value) -> Value:
    label = constant("encode", form)
    how = {"hex": lambda c: F.lower(F.hex(c)), "base64": _base64, "base64url": _base64_url}.get(str(label).lower())
    if how is None:
        raise ExprError(f"encode: unknown form {label!r}")
    return Value(how(raw("encode", b)), L.TEXT)


@function("decode", 2)
def decode(_: Context, s: Value, form: Value) -> Value:
    label = constant("decode", form)
    how = {"hex": _hex_bytes, "base64": _base64_bytes, "base64url": lambda c: _base64_bytes(c, True)}.get(str(label).lower())
    if how is None:
        raise ExprError(f"decode: unknown form {label!r}")
    return Value(how(need("decode", s, "Text").col), L.BYTES)


def _label(name: str, label: Value) -> str:
    import codecs

    found = constant(name, need(name, label, "Text"))
    try:
        # What browsers call latin1 and ascii is windows-1252.
        codec = codecs.lookup("windows-1252" if found.strip().lower() in ("latin1", "iso-8859-1", "ascii", "us-ascii") else found.strip())
    except LookupError:
        raise ExprError(f"{name}: unknown encoding {found!r}") from None
    return codec.name


@function("encodeText", 2)
def encode_text(_: Context, s: Value, label: Value) -> Value:
    col, name = need("encodeText", s, "Text").col, _label("encodeText", label)
    return Value(col.cast("binary") if name == "utf-8" else encode_text_udf(col, F.lit(name)), L.BYTES)


@function("decodeText", 2)
def decode_text(_: Context, b: Value, label: Value) -> Value:
    return Value(decode_text_udf(raw("decodeText", b), F.lit(_label("decodeText", label))), L.TEXT)
