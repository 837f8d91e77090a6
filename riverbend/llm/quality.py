"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score: sigmoid of w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),
linear in the number of features. Features of a text: its words hashed to
``BUCKETS`` (log counts, unit length), statistics of its structure, and the
metadata column n_chars against the text's own length. Labels, lang, source and
doc_id are never features.

The machine is fitted in numpy on the driver on at most ``SAMPLE_ROWS``
labelled documents (labels in the order of a hash of their doc_id); every whole
text is scored.

Defined cases. Null and empty texts are scored by their (empty) features. Null
quality labels are not learned from; a doc_id with several labels counts with
each. With ``hold_out``, labels whose crc32(doc_id as text) mod 5 is 0 are not
learned from. Without labels every score is 0.5; with labels of one kind it is
near that kind. Repeated rows are scored alike. A missing n_chars column or a
null counts as the text's length. Empty table: empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbend.llm import shared, words
from riverbend.llm.langid import held_out

BUCKETS = 1 << 14
FACTORS = 8
SAMPLE_ROWS = 4000
EPOCHS = 12
DENSE = 18


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of hashed words in row order, and the dense statistics (rows, DENSE)."""
    buf, offsets = words.batch_bytes(texts)
    n = len(texts)
    size = (np.diff(offsets) - 1).astype(np.float64)
    safe = np.maximum(size, 1)
    starts, hashes = words.word_hashes(buf)
    at = np.searchsorted(starts, offsets)
    count = np.diff(at).astype(np.float64)
    word_row = np.repeat(np.arange(n), np.diff(at))
    key, times = np.unique(word_row * BUCKETS + (hashes >> np.uint64(50)).astype(np.int64), return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / norm[row] if row.size else value
    of_row = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda mask: np.bincount(of_row[mask], minlength=n) / safe
    lines = np.bincount(of_row[buf == 10], minlength=n) + 1.0
    letters = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    upper = (buf >= 65) & (buf <= 90)
    punct = (buf > 32) & (buf < 127) & ~letters & ~((buf >= 48) & (buf <= 57))
    doubled = np.zeros(buf.size, bool)
    doubled[1:] = (buf[1:] == buf[:-1]) & punct[1:]
    distinct = np.bincount(row, minlength=n)
    peak = np.zeros(n)
    np.maximum.at(peak, row, times)
    pair = np.zeros(hashes.size, bool)
    if hashes.size > 1:
        pair[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    stated = np.asarray(n_chars.cast(pa.float64()).fill_null(-1.0))
    chars = size - np.bincount(of_row[(buf & 0xC0) == 0x80], minlength=n)
    stated = np.where(stated < 0, chars, stated)
    dense = np.column_stack([
        np.log1p(size), np.log1p(count), size / np.maximum(count, 1) / 10, np.log1p(lines), np.log1p(size / lines), share(upper), share((buf >= 48) & (buf <= 57)),
        share(punct), share(doubled), share(buf >= 128), share((buf == 32) | (buf == 9)), distinct / np.maximum(count, 1), peak / np.maximum(count, 1),
        np.bincount(word_row[pair], minlength=n) / np.maximum(count, 1), share(buf == ord("|")) + share(buf == ord("<")), share((buf == ord(".")) | (buf == ord(","))),
        np.log1p(stated), (stated != chars).astype(float),
    ])
    return row, bucket, value, dense


@dataclass
class Machine:
    """w0, linear weights and factors of BUCKETS hashed words followed by DENSE statistics, which are standardised first."""

    bias: float
    linear: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def sums(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = dense.shape[0]
        x = np.clip((dense - self.mean) / self.scale, -5, 5)
        v, w = self.factor[BUCKETS:], self.linear[BUCKETS:]
        one, two = x @ v, (x * x) @ (v * v)
        line = x @ w
        if row.size:
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            present = row[start]
            vx = self.factor[bucket] * value[:, None]
            one[present] += np.add.reduceat(vx, start)
            two[present] += np.add.reduceat(vx * vx, start)
            line += np.bincount(row, self.linear[bucket] * value, n)
        return line, one, two

    def score(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        line, one, two = self.sums(row, bucket, value, dense)
        z = self.bias + line + 0.5 * (one * one - two).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = EPOCHS, batch: int = 64) -> Machine:
    """Adagrad on the logistic loss, with weight decay on factors and linear weights."""
    rng = np.random.default_rng(seed)
    p = (y.sum() + 0.5) / (y.size + 1)
    scale = np.where(dense.std(0) > 1e-9, dense.std(0), 1.0) if y.size else np.ones(DENSE)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(BUCKETS + DENSE), rng.normal(0, 0.05, (BUCKETS + DENSE, FACTORS)), dense.mean(0) if y.size else np.zeros(DENSE), scale)
    if not y.size or y.min() == y.max():
        m.factor[:] = 0
        return m
    seen_w, seen_v, seen_b = np.full(m.linear.shape, 1e-3), np.full(m.factor.shape, 1e-3), 1e-3
    for epoch in range(epochs):
        order = rng.permutation(y.size)
        rate = 0.1 / (1 + epoch / 4)
        for a in range(0, y.size, batch):
            pick = order[a:a + batch]
            row = np.concatenate([np.full(rows[i][0].size, k) for k, i in enumerate(pick)]).astype(np.int64)
            bucket = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in pick])
            x = np.clip((dense[pick] - m.mean) / m.scale, -5, 5)
            line, one, two = m.sums(row, bucket, value, dense[pick])
            z = m.bias + line + 0.5 * (one * one - two).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / pick.size
            at = np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + DENSE), pick.size)])
            of = np.concatenate([row, np.repeat(np.arange(pick.size), DENSE)])
            xs = np.concatenate([value, x.reshape(-1)])
            gx = g[of] * xs
            touched, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, gx) + 1e-4 * m.linear[touched]
            each = gx[:, None] * (one[of] - m.factor[at] * xs[:, None])
            gv = np.stack([np.bincount(back, each[:, f]) for f in range(FACTORS)], 1) + 1e-3 * m.factor[touched]
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            m.linear[touched] -= rate * gw / np.sqrt(seen_w[touched])
            m.factor[touched] -= 0.5 * rate * gv / np.sqrt(seen_v[touched])
            seen_b += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(seen_b)
    return m


def _inputs(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, hold_out: bool = True, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits the machine on the sampled labels' documents; features are made where the texts are."""
    shared.small_batches(docs.sparkSession)
    picked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if hold_out:
        picked = picked.where(~held_out(F.col("doc_id")))
    picked = picked.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    picked = shared.bounded_sample(picked, F.col("doc_id"), sample_rows)
    picked = shared.materialise(picked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows), "label-sample")
    # One text for each label, however many rows have its id: that of the least hash.
    own = F.xxhash64("text", "n_chars")
    least = _inputs(docs).select("doc_id", own.alias("h")).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("h").alias("h"))
    picked = shared.materialise(picked.join(least, "doc_id"), "label-rows")
    rows = _inputs(docs).withColumn("h", own).join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "y").agg(F.first("text").alias("text"), F.first("n_chars").alias("n_chars"))
    rows = rows.select("doc_id", "text", "n_chars", "y")  # at most sample_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, bucket, value, dense = features(b.column(1), b.column(2))
            at = np.searchsorted(row, np.arange(len(b) + 1))
            cut = lambda x, kind: [x[i:j].astype(kind).tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(cut(bucket, "<u2"), pa.binary()), pa.array(cut(value, "<f4"), pa.binary()), pa.array([d.tobytes() for d in dense.astype("<f8")], pa.binary())], names=["doc_id", "y", "bucket", "value", "dense"])

    got = rows.mapInArrow(shared.lean(run), "doc_id bigint, y double, bucket binary, value binary, dense binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["dense"])))
    sparse = [(np.frombuffer(r["bucket"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in got]
    dense = np.stack([np.frombuffer(r["dense"], "<f8") for r in got]) if got else np.zeros((0, DENSE))
    return fit(sparse, dense, np.array([r["y"] for r in got]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(*features(b.column(1), b.column(2))))], names=["doc_id", "score"])

    return _inputs(docs).mapInArrow(shared.lean(run), "doc_id bigint, score double")
