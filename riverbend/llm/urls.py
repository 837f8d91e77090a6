"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

The trees are trained in numpy on URLs that the rules label, at most
``sample_rows`` of them, taken in the order of a hash of the row (a bounded
fit; every row is judged). Features: lengths, path depth, digit ratio, byte
entropy, counts of parameters and separators, and statistics of the host's
suffixes (how often the labelled sample has them, and their smoothed rate of
blocked URLs).

Defined cases. Null or empty URL, or one without ``://``: host and path are
empty, no rule fits, the trees judge it by its features (a null counts as
empty text). Without labelled URLs everything unruled is allowed; with labels
of one kind the trees fall back to that kind's prior. Repeated rows are judged
alike; equal rows of one sample rank are taken in URL order. Empty table:
empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbend.llm import shared, words

SAMPLE_ROWS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Judges a host and its subdomains where the URL's path starts with the rule's path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruling (null where no rule fits); the longest fitting rule wins."""
    url = F.col("url").cast("string")
    host, path = parts(url)
    x = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule = ruling = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, ruling = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(ruling)
    return x.withColumns({"rule": rule, "ruling": ruling})


def lexical(urls: pa.Array) -> np.ndarray:
    """One row of features for each URL."""
    buf, offsets = words.batch_bytes(urls)
    n = len(urls)
    size = (np.diff(offsets) - 1).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    count = lambda mask: np.bincount(row[mask], minlength=n).astype(np.float64)
    of = lambda c: count(buf == ord(c))
    digits = count((buf >= 48) & (buf <= 57))
    letters = count(((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122)))
    by_byte = np.zeros((n, 256))
    for a in range(0, n, 4096):  # bounded scratch
        b = min(a + 4096, n)
        part = slice(offsets[a], offsets[b])
        by_byte[a:b] = np.bincount((row[part] - a) * 256 + buf[part], minlength=(b - a) * 256).reshape(b - a, 256)
    by_byte[:, 0] = 0
    share = by_byte / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    safe = np.maximum(size, 1)
    return np.column_stack([size, of("/"), digits, digits / safe, letters / safe, entropy, of("="), of("&") + of("?"), of("."), of("-"), of("_"), of("%"), of("#"), of("@")])


def suffixes(hosts: list[str]) -> list[tuple[str, str]]:
    return [(h.rsplit(".", 1)[-1], ".".join(h.rsplit(".", 2)[-2:])) for h in hosts]


class SuffixStatistics:
    """Frequency and smoothed blocked rate of host suffixes in the labelled sample (bounded by the sample)."""

    def __init__(self, hosts: list[str], y: np.ndarray, smoothing: float = 20.0):
        self.smoothing, self.prior, self.of = smoothing, float(y.mean()) if y.size else 0.0, {}
        for pair, label in zip(suffixes(hosts), y.tolist(), strict=True):
            for key in set(pair):
                n, bad = self.of.get(key, (0, 0.0))
                self.of[key] = (n + 1, bad + label)

    def features(self, hosts: list[str], y: np.ndarray | None = None) -> np.ndarray:
        """With y, each row's own label is left out of its statistics."""
        out = np.zeros((len(hosts), 4))
        for i, pair in enumerate(suffixes(hosts)):
            for k, key in enumerate(pair):
                n, bad = self.of.get(key, (0, 0.0))
                if y is not None:
                    n, bad = n - 1, bad - y[i]
                out[i, 2 * k] = np.log1p(n)
                out[i, 2 * k + 1] = (bad + self.smoothing * self.prior) / (n + self.smoothing)
        return out


class BoostedTrees:
    """Histogram gradient boosting for the logistic loss: depth-wise trees stored as flat arrays."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = (y.sum() + 0.5) / (y.size + 1.0)
        self.base = float(np.log(p / (1 - p)))
        if y.size == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
        score = np.full(y.size, self.base)
        nodes = 2 ** self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut, leaf = np.full(nodes, -1), np.zeros(nodes), np.zeros(2 ** self.depth)
            where = np.zeros(y.size, np.int64)
            for level in range(self.depth):
                first, width = 2 ** level - 1, 2 ** level
                best = np.full(width, 1e-6)
                pick = np.full((width, 2), -1)
                for f in range(x.shape[1]):
                    b = len(cuts[f]) + 1
                    if b < 2:
                        continue
                    key = where * b + binned[:, f]
                    G, H, N = (np.bincount(key, w, minlength=width * b).reshape(width, b).cumsum(1) for w in (g, h, None))
                    left, right = slice(None, -1), slice(-1, None)
                    gain = G[:, left] ** 2 / (H[:, left] + self.l2) + (G[:, right] - G[:, left]) ** 2 / (H[:, right] - H[:, left] + self.l2) - G[:, right] ** 2 / (H[:, right] + self.l2)
                    gain[(N[:, left] < self.least) | (N[:, right] - N[:, left] < self.least)] = 0
                    at = gain.argmax(1)
                    value = gain[np.arange(width), at]
                    better = value > best
                    best[better], pick[better, 0], pick[better, 1] = value[better], f, at[better]
                for k in np.flatnonzero(pick[:, 0] >= 0):
                    feature[first + k], cut[first + k] = pick[k, 0], cuts[pick[k, 0]][pick[k, 1]]
                f = pick[where, 0]
                right = (f >= 0) & (binned[np.arange(y.size), np.maximum(f, 0)] > pick[where, 1])
                where = where * 2 + right
            G, H = np.bincount(where, g, leaf.size), np.bincount(where, h, leaf.size)
            leaf = -self.rate * G / (H + self.l2)
            self.model.append((feature, cut, leaf))
            score = score + leaf[where]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(x.shape[0], self.base)
        rows = np.arange(x.shape[0])
        for feature, cut, leaf in self.model:
            where = np.zeros(x.shape[0], np.int64)
            for level in range(self.depth):
                node = 2 ** level - 1 + where
                f = feature[node]
                where = where * 2 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
            score += leaf[where]
        return 1 / (1 + np.exp(-score))


@dataclass
class UrlModel:
    trees: BoostedTrees
    stats: SuffixStatistics

    def score(self, urls: pa.Array, hosts: list[str]) -> np.ndarray:
        return self.trees.predict(np.hstack([lexical(urls), self.stats.features(hosts)])) if len(hosts) else np.zeros(0)


def train(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> UrlModel | None:
    """Fits the trees on URLs that a rule labels; None without any."""
    labelled = ruled(pages, rules).where(F.col("ruling").isNotNull())
    labelled = shared.bounded_sample(labelled, F.struct("page_id", "url"), sample_rows)
    rows = labelled.select("url", "host", (F.col("ruling") == "block").cast("double").alias("y"), F.xxhash64("page_id", "url").alias("h")).orderBy("h", "url").limit(sample_rows).collect()
    if not rows:
        return None
    y, hosts = np.array([r["y"] for r in rows]), [r["host"] for r in rows]
    stats = SuffixStatistics(hosts, y)
    x = np.hstack([lexical(pa.array([r["url"] for r in rows], pa.string())), stats.features(hosts, y)])
    return UrlModel(BoostedTrees().fit(x, y), stats)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the trees'), score (the trees' probability of block)."""
    model = train(pages, rules, sample_rows)
    held = pages.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, url, host, path, rule, ruling = b.columns
            score = held.value.score(url, host.to_pylist()) if held.value else np.zeros(len(url))
            verdict = pc.coalesce(ruling, pa.array(np.where(score >= threshold, "block", "allow").tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays([page, host, path, rule, verdict, pa.array(score)], schema=schema)

    shared.small_batches(pages.sparkSession, 4096)
    return ruled(pages, rules).mapInArrow(shared.lean(run), "page_id bigint, host string, path string, rule string, verdict string, score double")
