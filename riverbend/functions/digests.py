"""Digests and non-cryptographic hashes of texts (as UTF-8) and bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import Context, Value, constant, function, need
from riverbend.functions.outside import vectorised

MASK = (1 << 64) - 1


def _bytes(name: str, v: Value) -> Column:
    return need(name, v, "Text", "Bytes").col.cast("binary")


def _digest(name: str, how) -> None:
    @function(name, 1)
    def compiled(_: Context, v: Value) -> Value:
        return Value(how(_bytes(name, v)), L.TEXT)


_digest("md5", F.md5)
_digest("sha1", F.sha1)
_digest("sha256", lambda c: F.sha2(c, 256))
_digest("sha512", lambda c: F.sha2(c, 512))


@function("hmac", 3)
def hmac(_: Context, kind: Value, message: Value, key: Value) -> Value:
    """Composed of built-in digests; the key may be a column."""
    bits, block = {"sha256": (256, 64), "sha512": (512, 128)}.get(str(constant("hmac", kind)).lower(), (0, 0))
    if not bits:
        raise ExprError("hmac takes sha256 or sha512")
    m, k = _bytes("hmac", message), _bytes("hmac", key)
    short = F.when(F.octet_length(k) > block, F.unhex(F.sha2(k, bits))).otherwise(k)
    digits = F.rpad(F.hex(short), 2 * block, "0")

    def pad(byte: int) -> Column:
        # Each hexadecimal digit is exchanged for its exclusive or with the pad's.
        pair = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.lpad(F.hex(F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseXOR(F.lit(byte))), 2, "0"))
        return F.unhex(F.array_join(pair, ""))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), m), bits))
    return Value(F.when(k.isNotNull(), F.sha2(F.concat(pad(0x5C), inner), bits)), L.TEXT)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Batch:
    """Texts of a batch by falling size, so that those with a byte at some place are the first ones."""

    def __init__(self, values: list[bytes]):
        size = np.fromiter(map(len, values), np.int64, len(values))
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.start = (np.cumsum(size) - size)[self.order]
        self.raw = np.frombuffer(b"".join(values) + b"\0" * 8, np.uint8)

    def longer(self, n: int) -> int:
        """How many have more than n bytes."""
        return int(np.searchsorted(-self.size, -n))

    def back(self, found: np.ndarray) -> np.ndarray:
        out = np.empty_like(found)
        out[self.order] = found
        return out


def fnv1a64(values: list[bytes]) -> np.ndarray:
    """FNV-1a of every text at once, byte by byte."""
    b = _Batch(values)
    h = np.full(len(values), 0xCBF29CE484222325, np.uint64)
    for at in range(int(b.size[0]) if len(values) else 0):
        n = b.longer(at)
        h[:n] = (h[:n] ^ b.raw[b.start[:n] + at]) * np.uint64(0x100000001B3)
    return b.back(h)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def siphash24(values: list[bytes], k0: int = 0, k1: int = 0) -> np.ndarray:
    """SipHash-2-4 (Aumasson and Bernstein) of every text at once, word by word."""
    b = _Batch(values)
    v0, v1, v2, v3 = (np.full(len(values), k ^ c, np.uint64) for k, c in ((k0, 0x736F6D6570736575), (k1, 0x646F72616E646F6D), (k0, 0x6C7967656E657261), (k1, 0x7465646279746573)))

    def rounds(n: int, many: int) -> None:
        a, c, d, e = v0[:n], v1[:n], v2[:n], v3[:n]
        for _ in range(many):
            a += c
            c[:] = _rotated(c, 13) ^ a
            a[:] = _rotated(a, 32)
            d += e
            e[:] = _rotated(e, 16) ^ d
            a += e
            e[:] = _rotated(e, 21) ^ a
            d += c
            c[:] = _rotated(c, 17) ^ d
            d[:] = _rotated(d, 32)

    def absorb(n: int, m: np.ndarray) -> None:
        v3[:n] ^= m
        rounds(n, 2)
        v0[:n] ^= m

    def word(at: np.ndarray) -> np.ndarray:
        return b.raw[at[:, None] + np.arange(8)].view("<u8")[:, 0]

    for k in range(0, int(b.size[0]) - 7 if len(values) else 0, 8):
        n = b.longer(k + 7)
        absorb(n, word(b.start[:n] + k))
    rest = b.size % 8
    last = word(b.start + b.size - rest) & np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)[rest]
    absorb(len(values), last | (b.size.astype(np.uint64) << np.uint64(56)))
    v2 ^= np.uint64(0xFF)
    rounds(len(values), 4)
    return b.back(v0 ^ v1 ^ v2 ^ v3)


# Primes of CityHash64 1.0.2; fixed values.
K0, K1, K2, K3, MUL = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949C7DEFEBDBEFF, 0x9DDFEA08EB382D69


def _rotate(x: int, n: int) -> int:
    return x if n == 0 else ((x >> n) | (x << (64 - n))) & MASK


def _shift_mix(x: int) -> int:
    return x ^ (x >> 47)


def _hash16(u: int, v: int) -> int:
    a = _shift_mix(((u ^ v) * MUL) & MASK)
    return _shift_mix(((v ^ a) * MUL) & MASK) * MUL & MASK


def city64(s: bytes) -> int:
    """CityHash64, version 1.0.2."""
    n = len(s)
    f8 = lambda i: int.from_bytes(s[i:i + 8], "little")
    f4 = lambda i: int.from_bytes(s[i:i + 4], "little")
    if n <= 16:
        if n > 8:
            a, b = f8(0), f8(n - 8)
            return _hash16(a, _rotate((b + n) & MASK, n)) ^ b
        if n >= 4:
            return _hash16((n + (f4(0) << 3)) & MASK, f4(n - 4))
        if n:
            y, z = s[0] + (s[n >> 1] << 8), n + (s[n - 1] << 2)
            return _shift_mix((y * K2 ^ z * K3) & MASK) * K2 & MASK
        return K2
    if n <= 32:
        a, b, c, d = f8(0) * K1 & MASK, f8(8), f8(n - 8) * K2 & MASK, f8(n - 16) * K0 & MASK
        return _hash16((_rotate((a - b) & MASK, 43) + _rotate(c, 30) + d) & MASK, (a + _rotate(b ^ K3, 20) - c + n) & MASK)
    if n <= 64:
        z, a = f8(24), (f8(0) + (n + f8(n - 16)) * K0) & MASK
        b, c = _rotate((a + z) & MASK, 52), _rotate(a, 37)
        a = (a + f8(8)) & MASK
        c = (c + _rotate(a, 7)) & MASK
        a = (a + f8(16)) & MASK
        vf, vs = (a + z) & MASK, (b + _rotate(a, 31) + c) & MASK
        a, z = (f8(16) + f8(n - 32)) & MASK, f8(n - 8)
        b, c = _rotate((a + z) & MASK, 52), _rotate(a, 37)
        a = (a + f8(n - 24)) & MASK
        c = (c + _rotate(a, 7)) & MASK
        a = (a + f8(n - 16)) & MASK
        wf, ws = (a + z) & MASK, (b + _rotate(a, 31) + c) & MASK
        r = _shift_mix(((vf + ws) * K2 + (wf + vs) * K0) & MASK)
        return _shift_mix((r * K0 + vs) & MASK) * K2 & MASK

    def weak(at: int, a: int, b: int) -> tuple[int, int]:
        w, x, y, z = f8(at), f8(at + 8), f8(at + 16), f8(at + 24)
        a = (a + w) & MASK
        b = _rotate((b + a + z) & MASK, 21)
        c = a
        a = (a + x + y) & MASK
        return (a + z) & MASK, (b + _rotate(a, 44) + c) & MASK

    x, y, z = f8(0), f8(n - 16) ^ K1, f8(n - 56) ^ K0
    v = weak(n - 64, n, y)
    w = weak(n - 32, n * K1 & MASK, K0)
    z = (z + _shift_mix(v[1]) * K1) & MASK
    x = _rotate((z + x) & MASK, 39) * K1 & MASK
    y = _rotate(y, 33) * K1 & MASK
    for at in range(0, (n - 1) // 64 * 64, 64):
        x = _rotate((x + y + v[0] + f8(at + 16)) & MASK, 37) * K1 & MASK
        y = _rotate((y + v[1] + f8(at + 48)) & MASK, 42) * K1 & MASK
        x ^= w[1]
        y ^= v[0]
        z = _rotate(z ^ w[0], 33)
        v = weak(at, v[1] * K1 & MASK, (x + w[0]) & MASK)
        w = weak(at + 32, (z + w[1]) & MASK, y)
        z, x = x, z
    return _hash16((_hash16(v[0], w[0]) + _shift_mix(y) * K1 + z) & MASK, (_hash16(v[1], w[1]) + x) & MASK)


_HASHES = {"xxHash64": lambda b: signed(xxhash.xxh64_intdigest(bytes(b))), "xxHash32": lambda b: xxhash.xxh32_intdigest(bytes(b)), "cityHash64": lambda b: signed(city64(bytes(b)))}
_BATCHES = {"sipHash64": siphash24, "fnv1a64": fnv1a64}


def _hash(name: str, udf) -> None:
    @function(name, 1)
    def compiled(_: Context, v: Value) -> Value:
        return Value(udf(_bytes(name, v)), L.INT64)


def _of_batches(f):
    def call(column: pa.Array) -> pa.Array:
        return pa.array(f([b if b is not None else b"" for b in column.to_pylist()]).view(np.int64), mask=np.asarray(column.is_null()))

    return F.arrow_udf(call, T.LongType())


for _name, _f in _HASHES.items():
    _hash(_name, vectorised(object, "bigint", _f))
for _name, _f in _BATCHES.items():
    _hash(_name, _of_batches(_f))
