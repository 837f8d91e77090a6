"""Vectorised words of whole texts.

A word is a maximal run of ASCII letters (A-Z lower-cased), ASCII digits and
non-ASCII code points. In UTF-8 that is a property of single bytes, so words
and their 64-bit hashes come from numpy passes over a batch's bytes. Texts are
handled in bounded segments cut between words; nothing is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_CODE[65:91] = _BYTE_CODE[97:123]  # A-Z as a-z
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SEGMENT + 1)
        _tables["up"] = _powers(_MULT, size)
        _tables["down"] = _powers(pow(_MULT, -1, 1 << 64), size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment(buf: np.ndarray, base: int, starts: list, hashes: list) -> None:
    inside = _IS_WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate([[0], edge])
    if edge.size % 2:
        edge = np.append(edge, inside.size)
    if not edge.size:
        return
    first, last = edge[0::2], edge[1::2]
    up, down = _power_tables(buf.size + 1)
    total = np.empty(buf.size + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[buf] * up[:buf.size], out=total[1:])
    value = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)
    starts.append(first + base)
    hashes.append(mix(value) | np.uint64(1))


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, 64-bit odd hash) of every word in the bytes."""
    starts: list = []
    hashes: list = []
    at = 0
    while at < buf.size:
        end = min(at + SEGMENT, buf.size)
        if end < buf.size:  # cut between words; one giant word lengthens its segment
            gaps = np.flatnonzero(~_IS_WORD[buf[at:end]])
            if gaps.size:
                end = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(~_IS_WORD[buf[end:]])
                end = end + int(more[0]) + 1 if more.size else buf.size
        _segment(buf[at:end], at, starts, hashes)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts).astype(np.int64), np.concatenate(hashes)


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with a NUL after each row's text, offsets of rows); null counts as empty."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    sizes = np.asarray(pc.binary_length(raw), dtype=np.int64)
    joined = pc.binary_join_element_wise(raw, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\0", pa.large_binary()))
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=offsets[1:])
    if not len(raw):
        return np.empty(0, np.uint8), offsets
    at = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset:joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], dtype=np.uint8)[at[0]:at[-1]], offsets


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the batch, offsets of each row's words)."""
    buf, offsets = batch_bytes(column)
    starts, hashes = word_hashes(buf)
    return hashes, np.searchsorted(starts, offsets)


_SHINGLE_MULT = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(64)]


def batch_shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, offsets of rows' words, word hashes); a text of fewer words than size, but not none, has one shingle."""
    words, offsets = batch_words(column)
    counts = np.diff(offsets)
    n = words.size
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), offsets, words
    row_of = np.repeat(np.arange(counts.size), counts)
    left = np.repeat(offsets[1:], counts) - np.arange(n)  # words to the row's end
    value = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, n)):
        ok = left > k
        value[:n - k] += np.where(ok[:n - k], words[k:] * _SHINGLE_MULT[k + 1], np.uint64(0)) if k else words * _SHINGLE_MULT[1]
    use = (left >= size) | ((np.arange(n) == np.repeat(offsets[:-1], counts)) & (np.repeat(counts, counts) < size))
    return row_of[use], mix(value[use]), offsets, words
