"""Benchmark decontamination with suffix arrays over the training texts.

Every Arrow batch of training rows is a shard: its words (64-bit hashes, a
separator after each row) get a suffix array ordered to the window's depth by
prefix doubling. Every suffix of every benchmark item is binary-searched in
it, word by word, which gives the interval of training positions that hold the
item's window. Windows that continue on both sides are chained into longest
verbatim matches with their locations. Training rows are never shuffled, so
no document, passage or item can overload a task.

Defined cases. Null or empty text: no words, no hits, not contaminated. Empty
benchmark: nothing is hit. Items of fewer words than the window, but not none,
are one window; items without words never occur. Repeated item rows count once
by id; an item whose id is null is reported as ``null``, and is another one than an item named so. Repeated documents are
judged row by row. Other columns of the input are ignored by name, so clashes
cannot happen: results carry the columns listed in SCHEMA only.
Words are compared by 64-bit hashes; a false hit needs colliding hashes of all
the window's words.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbend.llm import shared, words

WINDOW = 10
#: Benchmark text in one block, about; blocks are files in the shared folder, made by tasks, and a task holds one at a time.
BLOCK_BYTES = 8 << 20
#: Stands before the name of the item without an id while items are told apart.
_NO_ID = "\x01"

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "longest_match bigint, matches array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
    ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()),
    ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))),
])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals, and each one's interval."""
    n = hi - lo
    which = np.repeat(np.arange(lo.size), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


class Suffixes:
    """Item suffixes: distinct word windows, and which (item, position) each one stands for."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        column = pa.array(texts, pa.large_string())
        hashes, offsets = words.batch_words(column)
        counts = np.diff(offsets)
        size = np.minimum(window, counts)
        starts = np.where(counts > 0, counts - size + 1, 0)
        at, row = _ranges(offsets[:-1], offsets[:-1] + starts)
        length = size[row]
        # Windows are named by 128 bits of their words' hashes.
        one, two = (np.zeros(at.size, np.uint64) for _ in range(2))
        for k in range(window):
            own = length > k
            word = hashes[at[own] + k]
            one[own] = words.mix(one[own] * np.uint64(0x9E3779B97F4A7C15) + word)
            two[own] = words.mix(two[own] * np.uint64(0xD6E8FEB86659FD93) ^ word)
        order = np.lexsort((at, two, one, length))
        new = np.ones(order.size, bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]) | (length[order[1:]] != length[order[:-1]])
        self.window, self.words = window, hashes
        self.ids = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.ids)}
        head = np.flatnonzero(new)
        self.first, self.length = at[order[head]], length[order[head]]
        self.place_offsets = np.append(head, order.size).astype(np.int64)
        self.place_item = np.array([number[x] for x in ids], np.int64)[row[order]]
        self.place_at = (at - offsets[:-1][row])[order]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, window=self.window, ids=np.array(self.ids, dtype=object).astype("U") if self.ids else np.array([], "U1"),
                 **{k: getattr(self, k) for k in ("words", "first", "length", "place_offsets", "place_item", "place_at")})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Suffixes:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for k in ("words", "first", "length", "place_offsets", "place_item", "place_at"):
                setattr(self, k, z[k])
            self.window, self.ids = int(z["window"]), z["ids"].tolist()
        return self


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of seq ordered by their next ``depth`` values (prefix doubling; the end sorts first)."""
    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(key.size, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        return order, rank

    order, rank = ranked(seq)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(seq.size, np.uint64)
        after[:max(seq.size - step, 0)] = rank[step:]
        order, rank = ranked((rank << np.uint64(32)) | after)
        have += step
    return order


def _bounds(column: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Vectorised binary search of each want in its own interval of a lazily read sorted column."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while open_.size:
        mid = (lo[open_] + hi[open_]) >> 1
        value = column(mid)
        go = value <= want[open_] if right else value < want[open_]
        lo[open_[go]] = mid[go] + 1
        hi[open_[~go]] = mid[~go]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(seq: np.ndarray, order: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, from, to): the windows that occur, and the interval of the suffix array that starts with each."""
    live = np.arange(suffixes.first.size)
    ordered = seq[order]
    want = suffixes.words[suffixes.first] if live.size else np.empty(0, np.uint64)
    lo = np.searchsorted(ordered, want, "left")
    hi = np.searchsorted(ordered, want, "right")
    for k in range(1, suffixes.window + 1):
        keep = lo < hi
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if not live.size or k == suffixes.window:
            break
        deeper = suffixes.length[live] > k
        if not deeper.any():
            continue
        want = suffixes.words[suffixes.first[live[deeper]] + k]
        column = lambda mid, k=k: seq[np.minimum(order[mid] + k, seq.size - 1)]  # noqa: E731  a row's separator ends seq
        a, b = lo[deeper], hi[deeper]
        lo[deeper], hi[deeper] = _bounds(column, want, a, b, False), _bounds(column, want, a, b, True)
    return live, lo, hi


def judge(column: pa.Array, blocks: list[str], window: int, locate: bool = True) -> dict[str, list]:
    """Results of one shard (all rows of a batch) against all blocks of item suffixes; without locate, only which words are hit."""
    hashes, offsets = words.batch_words(column)
    rows = len(column)
    counts = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), counts)
    seq = np.zeros(hashes.size + rows, np.uint64)  # 0 after each row; word hashes are odd
    place = np.arange(hashes.size) + row_of
    seq[place] = hashes
    row_at = np.repeat(np.arange(rows), counts + 1)
    row_start = offsets[:-1] + np.arange(rows)
    order = suffix_array(seq, window) if hashes.size else np.empty(0, np.int64)
    edges = np.zeros(seq.size + 1, np.int64)
    found: list = [{} for _ in range(rows)]
    matches: list = [[] for _ in range(rows)]
    for block in blocks if hashes.size else []:
        s = _cached(block)
        live, lo, hi = search(seq, order, s)
        if not live.size:
            continue
        index, which = _ranges(lo, hi)
        at, win = order[index], live[which]
        size = s.length[win]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        if not locate:
            continue
        each, back = _ranges(s.place_offsets[win], s.place_offsets[win + 1])
        item, ipos, dpos, length = s.place_item[each], s.place_at[each], at[back], size[back]
        by = np.lexsort((dpos, dpos - ipos, item, row_at[dpos]))
        item, ipos, dpos, length = item[by], ipos[by], dpos[by], length[by]
        row = row_at[dpos]
        new = np.ones(dpos.size, bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | ((dpos - ipos)[1:] != (dpos - ipos)[:-1]) | (dpos[1:] - dpos[:-1] > 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], dpos.size) - 1
        for a, b in zip(head.tolist(), tail.tolist(), strict=True):
            r = int(row[a])
            name = s.ids[item[a]]
            found[r][name] = True
            matches[r].append({"item_id": name.lstrip(_NO_ID), "doc_word": int(dpos[a] - row_start[r]), "item_word": int(ipos[a]), "n_words": int(dpos[b] + length[b] - dpos[a])})
    hit = np.cumsum(edges[:-1]) > 0
    n_hit = np.bincount(row_at[hit], minlength=rows)
    if not locate:
        return {"n_words": counts.tolist(), "n_hit": n_hit.tolist(), "contaminated": (n_hit > 0).tolist()}
    items = [sorted(x.lstrip(_NO_ID) for x in f) for f in found]
    return {
        "n_words": counts.tolist(), "n_hit": n_hit.tolist(), "n_items": [len(x) for x in items],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
        "contaminated": (n_hit > 0).tolist(), "longest_match": [max((m["n_words"] for m in x), default=0) for x in matches], "matches": matches,
    }


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """The benchmark's blocks as shared files, each made by a task from the distinct (item, text) of its share of the bytes."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(f"{_NO_ID}null"))
    items = shared.materialise(benchmark.select(name.alias("item_id"), F.col("text").cast("string").alias("text")).distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    folder = shared.new_folder(spark, "benchmark")

    def build(group: pa.Table) -> pa.Table:
        uri = f"{folder}/block-{group['block'][0].as_py()}.npz"
        shared.write_atomically(uri, Suffixes(group["item_id"].to_pylist(), group["text"].to_pylist(), window).dump())
        return pa.table({"uri": [uri]})

    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"))
    made = shared.materialise(dealt.groupBy("block").applyInArrow(build, "uri string"), "blocks")
    return sorted(r["uri"] for r in made.collect())


def _read(uri: str) -> bytes:
    store, path = shared.filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


_last: dict = {}


def _cached(uri: str) -> Suffixes:
    if _last.get("key") != uri:
        _last.clear()
        _last.update(key=uri, value=Suffixes.load(_read(uri)))
    return _last["value"]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs (columns: SCHEMA): hit words, items with occurring windows, verbatim matches with locations."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    blocks = _blocks(spark, benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": batch.column(0)} | judge(batch.column(1), blocks, window)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name != "doc_id" else out["doc_id"] for f in _ARROW], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(shared.lean(run), SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold any window of the benchmark; columns and rows are otherwise as given.

    The verdict is taken on the rows as they stream by, so no join and no shuffle is needed and repeated ids are safe.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    blocks = _blocks(spark, benchmark, window, block_bytes)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = pa.array(judge(batch.column(text_at), blocks, window, False)["contaminated"], pa.bool_())
            yield batch.filter(pc.invert(bad))

    return docs.mapInArrow(shared.lean(run), docs.schema)
