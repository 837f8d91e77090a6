"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. A shingle's weight is its count in the text times 1 + idf / max idf, so
   weights of one count differ by a factor of 2 at most and a passage that many
   documents share does not outweigh what tells them apart. Document frequencies
   are counted exactly over the whole corpus, by ranges of shingles, after each
   task has combined its own; shingles of one document are not kept. Comparisons
   use them all. Samples, which find candidates, use the frequencies of shingles in more than
   1 / ``FREQUENT`` of all there are, ``FREQUENT`` shingles at most, and take others as if in one document.
2. Each distinct word sequence gets ``BANDS`` x ``ROWS`` samples, hashed by band.
   Documents with one word sequence form a copy class at once (combined before
   the shuffle), so groups of copies of any size go on as one representative.
3. Representatives that share a band are candidates. Buckets are never expanded
   into all pairs: in each of three rounds a few members of every open bucket are
   centres and are compared with its members of other components; found links join
   components, and a bucket is closed when the members that were no centre yet
   lie in one component. What is left outside a bucket's largest component is
   then compared with the members of like total weight in blocks, within tasks, on
   their samples alone and each pair in its first common band only; members that have a like one left in a
   block then meet there with their tables, and a block gives no more links than join its components. So every
   candidate pair of different components is compared, and no link between different texts is lost.
4. Exact total weights (J <= min/max) and the samples themselves (``MATCHES`` of
   all) rule out pairs first. Comparisons then use the whole shingle tables of both
   texts and the exact weighted Jaccard similarity.
5. Components come from label propagation with pointer jumping on links
   between representatives, in DataFrames, each round written to the shared folder.
   A representative's name begins with its smallest doc_id, so that a component's
   smallest name is its class and nothing is joined by component.

Defined cases. Null and empty texts, and texts without a word, are linked to
nothing: class of their own. A text of 1 to 4 words is one shingle. Repeated
rows (equal doc_id and text) give one row each. Rows with a null doc_id are
compared like others; they get the smallest non-null doc_id of their class as class id, else null. The class id is
the smallest doc_id of the class. Empty table: empty result. Other columns
are ignored by ``classes``, and kept unchanged by ``drop_duplicates``, whatever
their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbend.llm import shared, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Of all samples, how many two texts must share to be compared. Texts of similarity 0.8 share fewer with a chance of 1e-7; 0 compares all candidates.
MATCHES = BANDS * ROWS // 2
#: Shingles at most whose frequencies the samples know: those in more than 1 / FREQUENT of all (document, shingle) pairs.
FREQUENT = 1 << 18
#: Shingles that a task combines before they are counted, shingles of a range on average, and the least number of ranges.
COMBINED, RANGE, RANGES = 1 << 20, 1 << 20, 256
#: Bits of the range that one shuffle resolves: its rows have 128 shingles on average. A corpus of more ranges takes another shuffle for so many bits more.
LEVEL_BITS = 13
#: Draws per hash function that shingles are mapped to.
DRAWS = 1 << 14
#: By round, from which members of an open bucket centres are taken and how many: anywhere first, then in the largest component,
#: which pulls in what is left at a cost of what is left. What is still left then is compared in blocks.
ROUNDS = (("any", 1), ("main", 1), ("main", 4))
#: Members of a bucket on each side of one block of the last comparison, and bytes of their tables, about.
BLOCK, BLOCK_BYTES = 4096, 24 << 20
#: Total weights of one class differ by less than this factor; texts of 0.8 and more are in one class or in neighbouring ones.
WEIGHT_CLASS = 1.3

_rng = np.random.default_rng(77)
_K = BANDS * ROWS
#: Gamma(2,1) and uniform draws of every hash function: 1/r, r, log c, beta.
_R = _rng.gamma(2.0, 1.0, (_K, DRAWS)).astype(np.float32) + np.float32(1e-6)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, (_K, DRAWS)) + 1e-9).astype(np.float32)
_BETA = _rng.random((_K, DRAWS)).astype(np.float32)
_TURN = _rng.integers(1, 1 << 63, _K, dtype=np.uint64) | np.uint64(1)


def _tables(column: pa.Array, digests: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """(row, shingle, count) of each row's distinct shingles in order, and each row's word-sequence digest."""
    row, shingle, offsets, hashes = words.batch_shingles(column, SHINGLE)
    n = len(column)
    if n >= 1 << 16:
        raise ValueError("a batch has too many rows")
    # 48 bits of the shingle's hash name it, the same in every batch.
    key, count = np.unique((row.astype(np.uint64) << np.uint64(48)) | (shingle >> np.uint64(16)), return_counts=True)
    row = (key >> np.uint64(48)).astype(np.int64)
    shingle = key & np.uint64((1 << 48) - 1)
    return row, shingle, count, _word_digests(hashes, offsets) if digests else []


def _word_digests(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's word sequence; None without words."""
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _weight_of(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(2 + n)).astype(np.float32)


def _pack(shingle: np.ndarray) -> bytes:
    """Ascending shingles as the first and 32-bit gaps; whole where a gap is longer."""
    gaps = np.diff(shingle)
    if not shingle.size or (gaps >> np.uint64(32)).any():
        return shingle.astype("<u8").tobytes()
    return shingle[:1].astype("<u8").tobytes() + gaps.astype("<u4").tobytes()


def _unpack(packed: bytes, many: int) -> np.ndarray:
    if len(packed) == 8 * many:
        return np.frombuffer(packed, "<u8")
    out = np.empty(many, np.uint64)
    out[:1] = np.frombuffer(packed, "<u8", 1)
    out[1:] = np.frombuffer(packed, "<u4", many - 1, 8)
    return np.cumsum(out, dtype=np.uint64)


_BY_RANGE = "part bigint, bundle bigint, many bigint, shingles binary, n binary"


def _by_range(shingle: np.ndarray, n: np.ndarray | None, bits: int, bundle: int | None) -> Iterator[pa.RecordBatch]:
    """Ascending shingles cut by their leading bits, in batches of about 2 MB; of n, places and values where it is over 1."""
    part = (shingle >> np.uint64(48 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if part.size else np.empty(0, np.int64)
    ends = np.append(cut[1:], part.size)
    step = max(1, cut.size * (1 << 18) // max(part.size, 1))

    def more(x: slice) -> bytes | None:
        if n is None:
            return None
        at = np.flatnonzero(n[x] > 1)
        return at.astype("<u4").tobytes() + n[x][at].astype("<u4").tobytes()

    for k in range(0, cut.size, step):
        some = [slice(a, b) for a, b in zip(cut[k:k + step].tolist(), ends[k:k + step].tolist(), strict=True)]
        columns = [
            pa.array(part[cut[k:k + step]]), pa.array([bundle] * len(some), pa.int64()), pa.array([x.stop - x.start for x in some], pa.int64()), pa.array([_pack(shingle[x]) for x in some], pa.binary()),
            pa.array([more(x) for x in some], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "bundle", "many", "shingles", "n"])


def _flat(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


def _added(rows: Iterable[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending shingles of rows (many, shingles, n) and their counts over all rows."""
    keys, counts = [], []
    for many, packed, more in rows:
        keys.append(_unpack(packed, many))
        n, pairs = np.ones(many, np.int64), np.frombuffer(more, "<u4")
        n[pairs[:pairs.size // 2]] = pairs[pairs.size // 2:]
        counts.append(n)
    shingle, n = _flat(keys, "<u8"), _flat(counts, "<i8")
    order = np.argsort(shingle, kind="stable")
    shingle, n = shingle[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    return shingle[first], np.add.reduceat(n, first)


@dataclass(frozen=True)
class Frequencies:
    """Exact document frequencies: rows n, range bits, the table (part, many, shingles, df; of shingles in 2 rows or more), and the frequent ones."""

    n: int
    bits: int
    table: DataFrame
    shingles: np.ndarray
    df: np.ndarray


def frequencies(docs: DataFrame) -> Frequencies:
    """Counts shingles by ranges of their hashes, so that a range is a bounded part of the corpus at any size.

    A task sends a shingle once for ``COMBINED`` of its own, so a shingle of many documents is a number beside it and not many rows.
    """
    text = docs.select(F.col("text").cast("string").alias("text"))
    size = text.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    bits = (max(RANGES, -(-(size["bytes"] or 0) // (6 * RANGE))) - 1).bit_length()  # a shingle in six bytes, about
    limit, first = COMBINED, min(bits, LEVEL_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            shingle = _tables(batch.column(0), False)[1]
            held.append(shingle)
            many += shingle.size
            if many >= limit:
                yield from _by_range(*np.unique(np.concatenate(held), return_counts=True), first, None)
                held, many = [], 0
        if many:
            yield from _by_range(*np.unique(np.concatenate(held), return_counts=True), first, None)

    def finer(to: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, many, now = [], 0, None
            for batch in batches:
                for part, size, packed, more in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                    if held and (part != now or many >= limit):
                        yield from _by_range(*_added(held), to, None)
                        held, many = [], 0
                    held.append((size, packed.as_py(), more.as_py()))
                    many, now = many + size, part
            if held:
                yield from _by_range(*_added(held), to, None)

        return run

    def add(group: pa.Table) -> pa.Table:
        shingle, df = _added(zip(group["many"].to_pylist(), group["shingles"].to_pylist(), group["n"].to_pylist(), strict=True))
        own, total = df > 1, int(df.sum())
        return pa.table({"part": group["part"][:1], "total": [total], "many": [int(own.sum())], "shingles": pa.array([_pack(shingle[own])], pa.binary()), "df": pa.array([df[own].astype("<u4").tobytes()], pa.binary())})

    counts, done = text.mapInArrow(shared.lean(count), _BY_RANGE), first
    while done < bits:
        done = min(bits, done + LEVEL_BITS)
        counts = counts.repartition("part").sortWithinPartitions("part").mapInArrow(shared.lean(finer(done)), _BY_RANGE)
    found = shared.materialise(counts.groupBy("part").applyInArrow(add, "part bigint, total bigint, many bigint, shingles binary, df binary"), "frequencies")
    total = found.agg(F.sum("total")).first()[0] or 0
    least = max(1, total // FREQUENT)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for many, packed, df in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                n = np.frombuffer(df.as_buffer(), "<u4")
                own = n > least
                if own.any():
                    yield pa.RecordBatch.from_pydict({"shingles": [_unpack(packed.as_buffer(), many)[own].astype("<u8").tobytes()], "df": [n[own].tobytes()]})

    rows = found.select("many", "shingles", "df").mapInArrow(frequent, "shingles binary, df binary").collect()  # FREQUENT shingles at most: each is in over 1 / FREQUENT of total
    shingle, df = _flat([np.frombuffer(r["shingles"], "<u8") for r in rows], "<u8"), _flat([np.frombuffer(r["df"], "<u4") for r in rows], "<u4")
    order = np.argsort(shingle)
    return Frequencies(size["n"], bits, found, shingle[order], df[order])


class SampleWeights:
    """Weights for samples: frequent shingles by their frequencies, others as if in one document."""

    def __init__(self, f: Frequencies):
        self.shingles, self.weight = f.shingles, _weight_of(f.df.astype(np.float64), f.n)
        self.usual = _weight_of(np.ones(1), f.n)[0]
        self.flag = np.zeros(1 << 21, bool)
        self.flag[self.shingles & np.uint64(self.flag.size - 1)] = True

    def of(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.full(shingle.size, self.usual, np.float32)
        if self.shingles.size:
            maybe = np.flatnonzero(self.flag[shingle & np.uint64(self.flag.size - 1)])
            at = np.minimum(np.searchsorted(self.shingles, shingle[maybe]), self.shingles.size - 1)
            same = self.shingles[at] == shingle[maybe]
            out[maybe[same]] = self.weight[at[same]]
        return count * out


def exact_weights(made: DataFrame, f: Frequencies) -> DataFrame:
    """node, packed (shingles and weights), weight (total): made's tables (node, packed with counts) with exact document frequencies.

    The tables ask by bundle, for each range at once, and a bundle's tables are bounded together.
    """
    bits, n, limit = f.bits, f.n, COMBINED * 3

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            name = int.from_bytes(os.urandom(8), "little", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([[x for x, _ in held]], pa.list_(pa.binary())), pa.array([[p for _, p in held]], pa.list_(pa.binary()))], names=["bundle", "nodes", "tables"])

        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and size + len(packed) > limit:
                    yield out()
                    held, size = [], 0
                held.append((node, packed))
                size += len(packed)
        if held:
            yield out()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _by_range(np.unique(np.concatenate([np.frombuffer(p, "<u8", len(p) // 12) for p in packed])), None, bits, bundle)

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        keys, df = np.empty(0, "<u8"), np.empty(0, "<u4")
        for many, packed, n in zip(known["many"].to_pylist(), known["shingles"], known["df"], strict=True):  # one row a range
            keys, df = _unpack(packed.as_buffer(), many), np.frombuffer(n.as_buffer(), "<u4")
        out = []
        for many, packed in zip(asks["many"].to_pylist(), asks["shingles"], strict=True):
            wanted = _unpack(packed.as_buffer(), many)
            found = np.ones(many, "<u4")
            if keys.size:
                at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
                same = keys[at] == wanted
                found[same] = df[at[same]]
            out.append(found.tobytes())
        return pa.table({"part": asks["part"], "bundle": asks["bundle"], "df": pa.array(out, pa.binary())})

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = [p for row in left["tables"].to_pylist() for p in row]
        nodes = [x for row in left["nodes"].to_pylist() for x in row]
        df = _flat([np.frombuffer(x.as_buffer(), "<u4") for x in right.sort_by("part")["df"]], "<u4")
        shingles = [np.frombuffer(p, "<u8", len(p) // 12) for p in packed]
        keys = np.unique(_flat(shingles, "<u8"))
        weight_of = _weight_of(df.astype(np.float64), n)
        out, totals = [], []
        for p, s in zip(packed, shingles, strict=True):
            w = (np.frombuffer(p, "<f4", s.size, 8 * s.size) * weight_of[np.searchsorted(keys, s)]).astype("<f4")
            out.append(s.tobytes() + w.tobytes())
            totals.append(float(w.astype(np.float64).sum()))
        return pa.table({"node": pa.array(nodes, pa.binary()), "packed": pa.array(out, pa.binary()), "weight": pa.array(totals, pa.float64())})

    held = shared.materialise(made.mapInArrow(shared.lean(bundles), "bundle bigint, nodes array<binary>, tables array<binary>"), "bundles")
    asks = held.select("bundle", "tables").mapInArrow(shared.lean(ask), _BY_RANGE).drop("n")
    found = asks.groupBy("part").cogroup(f.table.select("part", "many", "shingles", "df").groupBy("part")).applyInArrow(answer, "part bigint, bundle bigint, df binary")
    found = shared.materialise(found, "answers")
    tables = shared.materialise(held.groupBy("bundle").cogroup(found.groupBy("bundle")).applyInArrow(weigh, "node binary, packed binary, weight double"), "tables")
    for done in (held, found, f.table):
        shared.discard(done)
    return tables


def samples(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Bands (rows x BANDS) by improved consistent weighted sampling: each is the 16-bit fragments of its ROWS samples side by side.

    For hash k and shingle s of weight w: t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the sample
    is the (s, t) of least a.
    """
    out = np.zeros((n, BANDS), np.uint64)
    if not row.size:
        return out
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    present = row[start]
    sizes = np.diff(np.append(start, row.size))
    segment = np.repeat(np.arange(start.size), sizes)
    log_w = np.log(weight).astype(np.float32)
    for k in range(_K):
        draw = ((shingle * _TURN[k]) >> np.uint64(50)).astype(np.int64)
        r, beta = _R[k][draw], _BETA[k][draw]
        t = np.floor(log_w / r + beta)
        a = _LOG_C[k][draw] - r * (t - beta + 1)
        least = np.minimum.reduceat(a, start)
        at = np.flatnonzero(a == least[segment])
        first = at[np.searchsorted(segment[at], np.arange(start.size))]
        pick = words.mix(shingle[first] * _TURN[k] + (t[first].astype(np.int64) + (1 << 20)).astype(np.uint64))
        band = k // ROWS
        out[present, band] = (out[present, band] << np.uint64(16)) | (pick & np.uint64(0xFFFF))
    return out


_BAND_NAMES = [f"b{i}" for i in range(BANDS)]


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame, weights) -> DataFrame:
    """doc_id, hash (of the text), digest (of the word sequence; null without words), b0 ... band hashes."""
    schema = "doc_id bigint, hash bigint, digest binary, " + ", ".join(f"{b} bigint" for b in _BAND_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, shingle, count, digest = _tables(batch.column(2))
            bands = samples(row, shingle, weights.value.of(shingle, count), len(batch)).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(bands[:, i]) for i in range(BANDS)], names=["doc_id", "hash", "digest", *_BAND_NAMES])

    return docs.select(F.col("doc_id").cast("bigint"), _text_hash(), F.col("text").cast("string")).mapInArrow(shared.lean(run), schema)


def _node(first: Column, digest: Column) -> Column:
    """A representative's name: whether it has no doc_id, its smallest doc_id and its digest, as bytes in that order."""
    sortable = F.lpad(F.hex(first.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.when(first.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), sortable)), F.hex(digest)))


def _doc_id(node: Column) -> Column:
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.substring(node, 1, 1) == F.lit(b"\0"), number.cast("bigint"))


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Exact weighted Jaccard similarity of two packed shingle tables (shingles ascend)."""
    na, nb = len(a) // 12, len(b) // 12
    sa, wa = np.frombuffer(a, "<u8", na), np.frombuffer(a, "<f4", na, 8 * na).astype(np.float64)
    sb, wb = np.frombuffer(b, "<u8", nb), np.frombuffer(b, "<f4", nb, 8 * nb).astype(np.float64)
    if not na or not nb:
        return 0.0
    at = np.minimum(np.searchsorted(sb, sa), nb - 1)
    both = sb[at] == sa
    common = np.minimum(wa[both], wb[at[both]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def _shared_samples(side: str, other: str) -> Column:
    """How many samples the bands of two texts share: 16-bit lanes without a difference."""
    total = F.lit(0)
    for b in _BAND_NAMES:
        apart = F.col(f"{side}.{b}").bitwiseXOR(F.col(f"{other}.{b}"))
        for lane in range(ROWS):
            total = total + (F.shiftrightunsigned(apart, 16 * lane).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int")
    return total


def _likely(pairs: DataFrame, sig: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose texts share that many samples; 112 bytes a text are shuffled."""
    if not matches:
        return pairs
    marks = sig.select("node", F.struct(*_BAND_NAMES).alias("bands"))
    x = pairs.join(marks.select(F.col("node").alias("a"), F.col("bands").alias("ma")), "a").join(marks.select(F.col("node").alias("b"), F.col("bands").alias("mb")), "b")
    return x.where(_shared_samples("ma", "mb") >= matches).select("a", "b")


def _verify(pairs: DataFrame, tables: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs with at least the similarity. Both tables of each pair are shuffled."""
    # Always the same plan, so that what is shuffled follows the input at every size.
    a, b = (tables.select(F.col("node").alias(x), F.col("packed").alias(f"p{x}")).hint("merge") for x in "ab")
    x = pairs.join(a, "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [weighted_jaccard(p.as_buffer(), q.as_buffer()) >= similarity for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return x.select("a", "b", "pa", "pb").mapInArrow(shared.lean(run), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node of its component) for every node of the links (a, b).

    Every round each node takes the smallest label of its neighbours, then its label's label (pointer jumping), so rounds grow
    with the logarithm of a component's diameter in practice. Minima are combined before each shuffle.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = shared.materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels", 2)
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = step.alias("s").join(label.select(F.col("node").alias("n2"), F.col("comp").alias("far")), F.col("s.comp") == F.col("n2"), "left")
        step = shared.materialise(step.select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels", 2)
        label = step.select("node", "comp")
        if not step.where("comp != old").head(1):
            return label


def _open(bands: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members of open buckets with their components, and each bucket's main component (the one with most members that were no centre).

    bands: band, hash, node, weight, done (it was a centre, so it is compared with everybody already). A closed bucket stays closed.
    """
    x = bands.withColumn("comp", F.col("node")) if comp is None else bands.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    x = x.select("band", "hash", "node", "weight", "done", "comp")
    left = x.where("not done")
    if comp is None:  # every member is a component
        open_ = left.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "hash", F.lit(None).cast("binary").alias("main"))
    else:
        sizes = left.groupBy("band", "hash", "comp").agg(F.count("*").alias("n"))
        open_ = sizes.groupBy("band", "hash").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("main")).where("comps > 1").select("band", "hash", F.col("main.comp").alias("main"))
    return shared.materialise(x.join(shared.materialise(open_, "buckets", 2), ["band", "hash"]), "open", 2)


def _centres(live: DataFrame, turn: int, where: str, many: int) -> DataFrame:
    draw = F.xxhash64("node", F.lit(turn))
    among = F.lit(True) if where == "any" else F.col("comp") == F.col("main")
    chosen = live.where(~F.col("done") & among).groupBy("band", "hash", F.pmod(draw, F.lit(many)).alias("slot")).agg(F.min(F.struct(draw.alias("draw"), "node", "comp", "weight")).alias("c"))
    return shared.materialise(chosen.select("band", "hash", F.col("c.node").alias("a"), F.col("c.comp").alias("ca"), F.col("c.weight").alias("wa")), "centres", 2)


class _Tables:
    """Packed shingle tables of a block, flat, so that one text is compared with many at once."""

    def __init__(self, packed: pa.Array):
        parts = [p.as_buffer() for p in packed]
        self.sizes = np.array([len(p) // 12 for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.shingle = _flat([np.frombuffer(p, "<u8", n) for p, n in zip(parts, self.sizes, strict=True)], "<u8")
        self.weight = _flat([np.frombuffer(p, "<f4", n, 8 * n) for p, n in zip(parts, self.sizes, strict=True)], "<f4").astype(np.float64)
        self.total = np.add.reduceat(np.append(self.weight, 0), self.start[:-1]) * (self.sizes > 0)

    def jaccard(self, p: int, q: np.ndarray) -> np.ndarray:
        """Exact weighted Jaccard similarities of row p with the rows q."""
        own = slice(self.start[p], self.start[p + 1])
        s, w = self.shingle[own], self.weight[own]
        n = self.sizes[q]
        at = np.arange(n.sum()) + np.repeat(self.start[q] - (np.cumsum(n) - n), n)
        other, row = self.shingle[at], np.repeat(np.arange(q.size), n)
        place = np.minimum(np.searchsorted(s, other), s.size - 1)
        both = s[place] == other
        common = np.bincount(row[both], np.minimum(w[place[both]], self.weight[at[both]]), q.size)
        return common / (self.total[p] + self.total[q] - common)


def _like(marks: np.ndarray, weight: np.ndarray, p: int, q: np.ndarray, band: int, similarity: float, matches: int) -> np.ndarray:
    """Those of q that may be like p by total weight and samples, and share no band before this one with it."""
    q = q[np.minimum(weight[q], weight[p]) >= np.maximum(weight[q], weight[p]) * (similarity - 1e-6)]
    apart = marks[q] ^ marks[p]
    return q[(apart[:, :band] != 0).all(1) & ((np.ascontiguousarray(apart).view(np.uint16) == 0).sum(1) >= matches)]


def _blocks(live: DataFrame, marks: DataFrame, tables: DataFrame, similarity: float, matches: int) -> DataFrame:
    """Links between what is outside a bucket's main component and its members that were no centre, as many as join their components.

    Members meet by classes of total weight, each with its neighbours, in blocks, by their samples. Members with a like one in a block
    meet there again with their tables, which a block has once each.
    """
    step = float(np.log(max(WEIGHT_CLASS, 1.04 / similarity)))
    undone = live.where("not done").drop("done").withColumn("class", F.floor(F.log("weight") / step))
    keep = ["band", "hash", "node", "weight", "comp"]
    left = undone.where(F.col("comp") != F.col("main")).select(*keep, F.lit(0).alias("side"), "class")
    right = undone.select(*keep, F.lit(1).alias("side"), F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    both = left.unionByName(right)
    # A table has 12 bytes for a shingle, whose weight is 1 at least.
    room = F.greatest(F.lit(64.0), F.least(F.lit(float(BLOCK)), BLOCK_BYTES / (F.lit(12.0) * F.exp((F.col("class") + 2) * step))))
    some = lambda side: F.ceil(F.sum((F.col("side") == side).cast("int")) / F.max(room)).cast("int")
    count = both.groupBy("band", "hash", "class").agg(some(0).alias("rows"), some(1).alias("cols")).where("rows > 0")
    x = both.join(shared.materialise(count, "block-counts", 2), ["band", "hash", "class"])
    draw = F.xxhash64("node", F.lit("block"))
    i, j = F.pmod(draw, F.col("rows")).cast("int"), F.pmod(draw, F.col("cols")).cast("int")
    one = x.where("side = 0").select(*keep, "side", "class", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    two = x.where("side = 1").select(*keep, "side", "class", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), j.alias("j"))
    members = one.unionByName(two).groupBy("band", "hash", "class", "i", "j", "node", "weight", "comp").agg(F.min("side").alias("least"), F.max("side").alias("most"))
    rows = members.withColumn("block", F.sha1(F.to_json(F.struct("band", "hash", "class", "i", "j")).cast("binary"))).select("block", "band", "node", "weight", "comp", "least", "most").join(marks, "node")

    columns = rows.columns

    def parts(group: pa.Table) -> tuple[np.ndarray, ...]:
        comp = group["comp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        own, other = (np.flatnonzero(group[c].to_numpy() == k) for c, k in (("least", 0), ("most", 1)))
        return np.stack([group[b].to_numpy() for b in _BAND_NAMES], 1), group["weight"].to_numpy(), comp, own, other, int(group["band"][0].as_py())

    def likely(group: pa.Table) -> pa.Table:
        marks_, weight, comp, own, other, band = parts(group)
        hit = np.zeros(weight.size, bool)
        for p in own:
            q = _like(marks_, weight, p, other[comp[other] != comp[p]], band, similarity, matches)
            hit[q] = True
            hit[p] |= q.size > 0
        return group.select(columns).filter(pa.array(hit))

    def verify(group: pa.Table) -> pa.Table:
        marks_, weight, comp, own, other, band = parts(group)
        held, node = _Tables(group["packed"].combine_chunks()), group["node"].to_pylist()
        comp = comp.copy()
        out: list[tuple[bytes, bytes]] = []
        for p in own:
            q = _like(marks_, weight, p, other[comp[other] != comp[p]], band, similarity, matches)
            q = q[held.jaccard(int(p), q) >= similarity] if q.size else q
            for c, k in zip(*np.unique(comp[q], return_index=True), strict=True):  # one link joins a component
                out.append((min(node[p], node[q[k]]), max(node[p], node[q[k]])))
                comp[comp == c] = comp[p]
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    met = shared.materialise(rows.groupBy("block").applyInArrow(likely, rows.schema), "block-members")
    full = met.join(tables.hint("merge"), "node")
    return full.groupBy("block").applyInArrow(verify, "a binary, b binary").distinct()


def links(sig: DataFrame, tables_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, rounds: tuple[tuple[str, int], ...] = ROUNDS, matches: int = MATCHES) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (a, b) found between representatives, and their components; sig has one row for each word sequence."""
    bands = sig.select("node", F.posexplode(F.array(*_BAND_NAMES)).alias("band", "hash"))
    shares = bands.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "hash")
    shares = shared.materialise(shares, "shared-bands")
    bands = shared.materialise(bands.join(shares, ["band", "hash"]).select("band", "hash", "node"), "candidates")
    shared.discard(shares)
    if not bands.head(1):
        return None, None
    nodes = shared.materialise(bands.select("node").distinct(), "nodes")
    marks = shared.materialise(sig.select("node", *_BAND_NAMES).join(nodes, "node"), "marks")
    tables = tables_of(nodes)
    bands = bands.join(tables.select("node", "weight"), "node").withColumn("done", F.lit(False))
    tables = tables.select("node", "packed")
    comp = found = tried = None

    def verified(pairs: DataFrame) -> DataFrame:
        with shared.batches(sig.sparkSession, 64):  # two whole tables a row
            return shared.materialise(_verify(pairs, tables, similarity), "links")

    for turn, (where, many) in enumerate(rounds):
        live = _open(bands, comp)
        if not live.head(1):
            return found, comp
        if turn == 1:  # most buckets are closed by now, and their tables are not shuffled again
            tables = shared.materialise(tables.hint("merge").join(live.select("node").distinct(), "node"), "open-tables")
        chosen = _centres(live, turn, where, many)
        # Members that were centres before have been compared with everybody in the bucket.
        pairs = live.where("not done").join(chosen, ["band", "hash"]).where((F.col("a") != F.col("node")) & (F.col("ca") != F.col("comp")))
        pairs = pairs.where(F.least("wa", "weight") >= F.greatest("wa", "weight") * (similarity - 1e-6))
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = shared.materialise(pairs, "pairs", 2)
        new = verified(shared.materialise(_likely(pairs, marks, matches), "likely", 2))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found is None or new.head(1):
            found = new if found is None else found.unionByName(new)
            comp = components(found)
        was = chosen.select("band", "hash", F.col("a").alias("node"), F.lit(True).alias("was"))
        bands = live.select("band", "hash", "node", "weight", "done").join(was, ["band", "hash", "node"], "left")
        bands = bands.select("band", "hash", "node", "weight", (F.col("done") | F.coalesce("was", F.lit(False))).alias("done"))
    live = _open(bands, comp)
    if live.head(1):
        new = shared.materialise(_blocks(live, marks, tables, similarity, matches), "links")
        if new.head(1):
            found = found.unionByName(new)
            comp = components(found)
    return found, comp


def classes(docs: DataFrame, similarity: float = SIMILARITY, matches: int = MATCHES) -> DataFrame:
    """doc_id, class_id, links (spanning links found at its text, not all texts that are like it), for every row of docs."""
    x = _members(docs, similarity, matches)
    return x.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def _members(docs: DataFrame, similarity: float, matches: int = MATCHES) -> DataFrame:
    """doc_id, hash, digest, class_id, links and stays for every row of docs: stays marks the rows with the class's smallest doc_id and, of its texts, the first by name."""
    spark = docs.sparkSession
    with shared.batches(spark), shared.temporary(spark):
        f = frequencies(docs)
        weights = spark.sparkContext.broadcast(SampleWeights(f))
        sig = shared.materialise(signatures(docs, weights), "signatures", keep=True)
        # The text of a representative is read at its smallest doc_id; rows without an id are read by their text alone.
        at = F.coalesce(F.min_by("hash", "doc_id"), F.min("hash")).alias("hash")
        reps = sig.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), at, *[F.min(b).alias(b) for b in _BAND_NAMES])
        reps = shared.materialise(reps.withColumn("node", _node(F.col("first"), F.col("digest"))), "representatives")
        repeated = bool(sig.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").head(1))

        def tables_of(nodes: DataFrame) -> DataFrame:
            """Whole shingle tables of the candidates."""
            rows = reps.select("node", "first", "hash").join(nodes, "node")
            texts = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("text").cast("string").alias("__text"), _text_hash().alias("__hash"))
            # Always the same plan, so that what is shuffled follows the input at every size.
            wanted = shared.materialise(rows, "wanted").hint("merge")
            picked = texts.join(wanted, (F.col("__hash") == F.col("hash")) & F.col("__id").eqNullSafe(F.col("first"))).select("node", F.col("__text").alias("text"))
            return exact_weights(_shingle_tables(picked.dropDuplicates(["node"]) if repeated else picked), f)

        found, comp = links(reps, tables_of, similarity, matches=matches)
        of = reps.select("digest", "node", F.col("first").alias("class_id"))
        if found is None:
            of = of.select("digest", "class_id", F.lit(0).cast("bigint").alias("links"), F.lit(True).alias("kept"))
        else:
            ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
            of = of.join(shared.materialise(comp.join(ends, "node"), "components", 2), "node", "left")
            of = of.select("digest", F.when(F.col("comp").isNull(), F.col("class_id")).otherwise(_doc_id(F.col("comp"))).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("comp").isNull() | (F.col("comp") == F.col("node"))).alias("kept"))
        of = shared.materialise(of, "classes", keep=True)
    x = sig.select("doc_id", "hash", "digest").join(of, "digest", "left")
    return x.withColumn("stays", F.col("digest").isNull() | (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("class_id"))))


def _shingle_tables(picked: DataFrame) -> DataFrame:
    """Shingle tables by node, with counts, of texts that are the node's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, shingle, count, digest = _tables(batch.column(1))
            at = np.searchsorted(row, np.arange(len(batch) + 1))
            nodes = batch.column(0).to_pylist()
            own = [i for i, d in enumerate(digest) if d and d == nodes[i][-16:]]
            packed = [shingle[at[i]:at[i + 1]].astype("<u8").tobytes() + count[at[i]:at[i + 1]].astype("<f4").tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in own], pa.binary()), pa.array(packed, pa.binary())], names=["node", "packed"])

    return picked.mapInArrow(shared.lean(run), "node binary, packed binary")


def drop_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the one with the smallest doc_id; columns as given.

    Rows are told apart by doc_id and text, so other texts under one doc_id stay or go by their own class. Of copies without an
    id one stays if no copy has an id. Rows without a word stay, but equal rows (doc_id, text) that have an id are one.
    """
    with shared.temporary(docs.sparkSession):
        found = shared.materialise(_members(docs, similarity).select("doc_id", "hash", "digest", "stays"), "members", keep=True)
    names = [F.col("doc_id").alias("__i"), F.col("hash").alias("__t")]
    own = F.coalesce(F.col("digest"), F.unhex(F.hex("hash")))
    stay = found.where("stays and (doc_id is not null or digest is not null)").select("doc_id", "hash", own.alias("own"))
    # Of rows with one id and word sequence, those with one text stay; they may still be several.
    again = stay.groupBy("doc_id", "own").agg(F.min("hash").alias("least"), F.count("*").alias("n")).where("n > 1")
    again = shared.materialise(again, "repeated")
    drop = found.where("not stays").select(*names)
    twice = bool(again.head(1))
    if twice:
        a = again.select(F.col("doc_id").alias("__d"), F.col("own").alias("__o"), "least")
        other = stay.join(a, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("own") == F.col("__o")) & (F.col("hash") != F.col("least")))
        drop = drop.unionByName(other.select(*names))
    # Always the same plan, so that what is shuffled follows the input at every size.
    drop = shared.materialise(drop.distinct(), "dropped").hint("merge")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("bigint").alias("__id"), _text_hash().alias("__h"))
    same = (F.col("__h") == F.col("__t")) & F.col("__id").eqNullSafe(F.col("__i"))
    rows = rows.join(drop, same, "left_anti")
    if not twice:
        return rows.select("__row.*")
    again = again.select(F.col("doc_id").alias("__i"), F.col("least").alias("__t"))
    once = rows.join(again, same, "left_anti").select("__row.*")
    return once.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["__id", "__h"]).select("__row.*"))
