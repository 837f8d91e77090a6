"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions, labels every
position, and a document's probabilities are the mean over all its positions.
It is trained in numpy by backpropagation through time (Adam) on the driver, on
windows of at most ``SAMPLE_DOCS`` labelled documents with a letter, taken in the order of a
hash of the row: ``SAMPLE_WINDOWS`` of a text, each anywhere in its part of the whole text. Every byte of every text is labelled when predicting.

Defined cases. Null text or text without a letter: ``und`` with score 0. Without
any labelled document there is nothing to learn: all are ``und``. Null lang: not
learned from. With ``hold_out``, documents whose crc32(doc_id as text) mod 5 is 0
are not learned from (a null doc_id is not held out). Ties go to the language
first by name. Repeated rows are judged alike. Empty table: empty result. Other
columns are ignored by ``predict`` and kept unchanged by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbend.llm import shared, words

WINDOW = 64
HIDDEN = 8
SAMPLE_DOCS = 4000
SAMPLE_WINDOWS = 3
STEPS = 260
BATCH = 192
BLOCK = 1024


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Network:
    """Byte tables (3H x 256: update, reset, candidate gates), recurrent weights (3H x H) and outputs (C x H) by direction; update and
    reset gates are sigmoids, written as (1 + tanh(x / 2)) / 2."""

    langs: list[str]
    table: list[np.ndarray]
    turn: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], rng: np.random.Generator, h: int = HIDDEN) -> Network:
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        return cls(langs, [draw(3 * h, 256, s=0.3) for _ in "fb"], [draw(3 * h, h, s=h ** -0.5) for _ in "fb"], [draw(len(langs), h, s=h ** -0.5) for _ in "fb"], np.zeros((len(langs), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.turn, *self.out, self.bias]

    def labels(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Probabilities (T, C, B) of every position of the windows x (T, B); real tells bytes from padding."""
        steps, b = x.shape
        logits = np.empty((steps, len(self.langs), b), np.float32)
        for d in (0, 1):
            h = np.zeros((self.turn[d].shape[1], b), np.float32)
            n = h.shape[0]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                gates = np.take(self.table[d], x[t], axis=1)
                pull = self.turn[d] @ h
                zr = np.tanh((gates[:2 * n] + pull[:2 * n]) * np.float32(0.5))
                zr += 1
                zr *= np.float32(0.5)
                pull[2 * n:] *= zr[n:]
                pull[2 * n:] += gates[2 * n:]
                new = np.tanh(pull[2 * n:])
                h -= new
                h *= zr[:n]
                h += new
                if d:
                    h *= real[t]
                    logits[t] += self.out[d] @ h
                else:
                    logits[t] = self.out[d] @ h + self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over all positions."""
        steps, b = x.shape
        kept: list = [[None] * steps, [None] * steps]
        logits = np.zeros((steps, len(self.langs), b), np.float32) + self.bias
        n = self.turn[0].shape[1]
        for d in (0, 1):
            h = np.zeros((n, b), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                gates, pull = np.take(self.table[d], x[t], axis=1), self.turn[d] @ h
                zr = 0.5 * (1 + np.tanh(0.5 * (gates[:2 * n] + pull[:2 * n])))
                z, r = zr[:n], zr[n:]
                c = np.tanh(gates[2 * n:] + r * pull[2 * n:])
                new = c + z * (h - c)
                if d:
                    new = new * real[t]
                kept[d][t] = (h, z, r, c, pull[2 * n:], new)
                h = new
                logits[t] += self.out[d] @ h
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, y, np.arange(b)] -= 1
        p *= (real / real.sum())[:, None, :]
        grads = [np.zeros_like(w) for w in self.parameters()]
        grads[6] += p.sum((0, 2))[:, None]
        for d in (0, 1):
            back = np.zeros((n, b), np.float32)
            flat_gate = np.empty((steps, 3 * n, b), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                h, z, r, c, pull, new = kept[d][t]
                grads[4 + d] += p[t] @ new.T
                dh = self.out[d].T @ p[t] + back
                if d:
                    dh = dh * real[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * pull * r * (1 - r)
                g = flat_gate[t]
                g[:n], g[n:2 * n], g[2 * n:] = dz, dr, dc
                inner = np.concatenate([dz, dr, dc * r])
                grads[2 + d] += inner @ h.T
                back = self.turn[d].T @ inner + dh * z
            byte = x.reshape(-1)
            for k in range(3 * n):
                grads[d][k] += np.bincount(byte, flat_gate[:, k, :].reshape(-1), 256)
        return grads


def windows(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) windows of the bytes and which positions are real."""
    b = max(1, -(-buf.size // WINDOW))
    x = np.zeros(b * WINDOW, np.uint8)
    x[:buf.size] = buf
    real = np.zeros(b * WINDOW, np.float32)
    real[:buf.size] = 1
    return np.ascontiguousarray(x.reshape(b, WINDOW).T), np.ascontiguousarray(real.reshape(b, WINDOW).T)


def train(docs: DataFrame, hold_out: bool = True, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS, seed: int = 5) -> Network | None:
    """A network for the languages of the sampled labelled documents; None without any."""
    text = F.col("text").cast("string")
    rows = docs.where(F.col("lang").isNotNull())
    if hold_out:
        rows = rows.where(~held_out(F.col("doc_id")))
    rows = shared.bounded_sample(rows.where(text.rlike(r"\p{L}")), F.struct(F.col("doc_id"), text), sample_docs)
    h = F.xxhash64(text, F.lit("sample"))
    part = F.floor(F.char_length(text) / SAMPLE_WINDOWS)
    at = lambda i: (part * i + F.pmod(F.xxhash64(text, F.lit(f"window {i}")), F.greatest(part - WINDOW, F.lit(0)) + 1) + 1).cast("int")
    pieces = F.array(*[F.substr(text, at(i), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)])
    rows = rows.select(F.col("lang").cast("string").alias("lang"), pieces.alias("pieces"), h.alias("h")).orderBy("h", "lang", "pieces").limit(sample_docs).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    xs, reals, ys = [], [], []
    for r in rows:
        for piece in r["pieces"]:
            x, real = windows(np.frombuffer(piece.encode(), np.uint8))
            xs.append(x)
            reals.append(real)
            ys.append(np.full(x.shape[1], langs.index(r["lang"])))
    x, real, y = np.concatenate(xs, 1), np.concatenate(reals, 1), np.concatenate(ys)
    net = Network.new(langs, rng)
    ready = real.sum(0) > 0
    x, real, y = x[:, ready], real[:, ready], y[ready]
    if len(langs) == 1:
        return net
    # Languages are drawn alike often, however many documents each has.
    draw = 1 / np.bincount(y, minlength=len(langs))[y]
    draw /= draw.sum()
    first = [np.zeros_like(w) for w in net.parameters()]
    second = [np.zeros_like(w) for w in net.parameters()]
    for step in range(1, steps + 1):
        pick = rng.choice(y.size, BATCH, p=draw)
        grads = net.gradients(x[:, pick], real[:, pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-6))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def pooled(net: Network, column: pa.Array) -> np.ndarray:
    """Mean probabilities (rows, languages) over all positions of each text; rows without bytes are 0."""
    buf, offsets = words.batch_bytes(column)
    size = np.diff(offsets) - 1
    count = -(-size // WINDOW)
    start = np.repeat(offsets[:-1], count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = start + nth * WINDOW
    length = np.minimum(WINDOW, np.repeat(offsets[1:] - 1, count) - start)
    row = np.repeat(np.arange(len(column)), count)
    sums = np.zeros((len(column), len(net.langs)))
    step = np.arange(WINDOW)[:, None]
    padded = np.concatenate([buf, np.zeros(WINDOW, np.uint8)])
    for a in range(0, start.size, BLOCK):
        part = slice(a, a + BLOCK)
        real = (step < length[part]).astype(np.float32)
        x = padded[start[part] + step] * real.astype(np.uint8)
        p = net.labels(x, real)
        p *= real[:, None, :]
        for k, total in enumerate(p.sum(0)):
            sums[:, k] += np.bincount(row[part], total, len(column))
    return sums / np.maximum(size, 1)[:, None]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    shared.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = best(held.value, b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), lang, score], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(shared.lean(run), "doc_id bigint, lang_pred string, score double")


def best(net: Network | None, texts: pa.Array, letters: pa.Array) -> tuple[pa.Array, pa.Array]:
    ok = np.asarray(letters, dtype=bool)
    if net is None:
        ok = np.zeros(len(texts), bool)
    probability = pooled(net, texts) if net is not None else np.zeros((len(texts), 1))
    at = probability.argmax(1)
    names = np.array(net.langs if net is not None else ["und"], object)
    return pa.array(np.where(ok, names[at], "und").tolist(), pa.string()), pa.array(np.where(ok, np.minimum(probability.max(1), 1.0), 0.0))


def keep_known(docs: DataFrame, net: Network | None, min_score: float = 0.0) -> DataFrame:
    """docs without the rows that are rejected: ``und``, or a score under min_score. Rows stream by; nothing is shuffled.

    A text of several languages has a low score in each however clean it is, so by default none is rejected for its score.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    shared.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = best(held.value, b.column(at), b.column(b.num_columns - 1))
            keep = (np.asarray(score) >= min_score) & np.array([x != "und" for x in lang.to_pylist()], bool)
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(keep))

    flagged = docs.select("*", F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    return flagged.mapInArrow(shared.lean(run), docs.schema)
