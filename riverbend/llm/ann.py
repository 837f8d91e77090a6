"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Distinct directions are dealt to shards of about ``SHARD_ROWS`` by hash. A shard's
graph is built in bulk: a node's level is drawn from its hash; on each layer
every node's nearest candidates are found by comparing all of the layer's nodes in blocks (a shard is of
fixed size, so that is a fixed cost for each row of the table), thinned by the
small-world selection rule (a candidate is kept if it is nearer to the node
than to any kept one), and linked back, into one int32 array of neighbours per
layer (-1 fills). Queries descend the layers with a beam, all queries of a
block at once, and the shards' results are merged by exact cosine similarity, which all nodes of the beam get.

Vectors of one direction (equal up to float32 rounding after division by their largest
component) share one node, which carries the smallest vec_ids (as many as
a result can hold, and one more for the query itself) with their vectors. So a vector that a third
of all rows have, or a third of all rows that are scaled copies of it, are one node, and exact ties
go to the smallest vec_ids. Scores are always those of a row's own vector; of rows of one direction whose
scores differ by rounding only, the smallest vec_ids count as the nearest.

Graphs and blocks of queries (``BLOCK_BYTES`` at most each) are files in the shared folder. A task loads one graph
and streams the blocks; nothing passes through the driver but one row per vector length and the names of the blocks.

Defined cases. Vectors that are null, empty or all zero, or hold a null or a
non-finite component, take no part, nor do rows with a null vec_id. Vectors of
different lengths never meet. Rows with the query's own vec_id are its own rows; an id with several vectors counts
by its nearest, and as a query by each of them.
Repeated rows count once. Fewer than k candidates: all of them. Empty table:
empty result. Other columns are ignored.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverbend.llm import shared, words

SHARD_ROWS = 16_384
#: Links of a node on upper layers; twice as many on the lowest.
LINKS = 16
CANDIDATES = 48
BEAM = 128
EXPAND = 4
BLOCK_BYTES = 16 << 20
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit float32 rows; scaled first so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine similarity in double precision on the vectors as given."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    odd = ~np.isfinite(out)
    if odd.any():
        a, b = (x[odd] / np.abs(x[odd]).max(1, keepdims=True) for x in (a, b))
        out[odd] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return out


def _links(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbours (n, most) of one layer's nodes: nearest candidates, thinned, then linked back."""
    n = x.shape[0]
    k = min(CANDIDATES, n - 1)
    out = np.full((n, most), -1, np.int32)
    if k < 1:
        return out
    half = max(1, most // 2)
    for a in range(0, n, 1024):
        sim = x[a:a + 1024] @ x.T
        rows = np.arange(sim.shape[0])
        sim[rows, rows + a] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        own = np.take_along_axis(sim, near, 1)
        vec = x[near]
        between = vec @ vec.transpose(0, 2, 1)
        kept = np.zeros((rows.size, k), bool)
        for j in range(k):
            crowded = ((between[:, j, :] > own[:, j, None]) & kept).any(1)
            kept[:, j] = ~crowded & (kept.sum(1) < half)
        # Places that thinning leaves are filled with the nearest others.
        order = np.argsort(~kept, axis=1, kind="stable")[:, :half]
        out[a:a + rows.size, :order.shape[1]] = np.take_along_axis(near, order, 1)
    width = min(half, k)
    src, dst = np.repeat(np.arange(n), width), out[:, :width].reshape(-1)
    sim = np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((-sim, dst))
    src, dst = src[order], dst[order]
    first = np.searchsorted(dst, np.arange(n))
    nth = np.arange(dst.size) - first[dst]
    use = nth < most - width
    out[dst[use], width + nth[use]] = src[use]
    return out


class Graph:
    """A shard: vectors (one of each node, then other members' where they differ), each node's ids and the places of their vectors, and
    per layer its nodes and their neighbours."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.ids, self.at, self.layers = vectors, ids, at, layers
        self.unit = _unit(vectors[:len(ids)])

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Graph:
        unit = _unit(vectors[:len(ids)])
        draw = (words.mix(ids[:, 0].astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
        layers = []
        for k in range(level.max() + 1):
            nodes = np.flatnonzero(level >= k)
            layers.append((nodes.astype(np.int32), _links(unit[nodes], 2 * LINKS if k == 0 else LINKS)))
            if nodes.size <= LINKS:
                break
        return cls(vectors, ids, at, layers)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, ids=self.ids, at=self.at, depth=len(self.layers), **{f"{name}{i}": x for i, layer in enumerate(self.layers) for name, x in zip(("nodes", "links"), layer, strict=True)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["vectors"], z["ids"], z["at"], [(z[f"nodes{i}"], z[f"links{i}"]) for i in range(int(z["depth"]))])

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the beam of each query, nearest first; -1 fills."""
        q = _unit(queries)
        at = np.repeat(np.zeros((1, 1), np.int64), q.shape[0], 0)
        for k in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.layers[k]
            width = beam if k == 0 else 16
            x = self.unit[nodes]
            start = at if k == len(self.layers) - 1 else np.where(at >= 0, np.searchsorted(nodes, np.maximum(at, 0)), -1)
            if k == len(self.layers) - 1:
                few = min(nodes.size, 4 * LINKS)  # the top layer has few nodes: all (or the first ones) are entries
                start = np.repeat(np.arange(few)[None, :], q.shape[0], 0)
            found, sim = _walk(x, links, q, start, width)
            at = np.where(found >= 0, nodes[np.maximum(found, 0)], -1)
        return at, sim


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries on one layer at once: the best unexpanded nodes of each beam are expanded until none is left."""
    rows = np.arange(q.shape[0])[:, None]
    seen = np.zeros((q.shape[0], x.shape[0] + 1), bool)
    seen[:, -1] = True
    sim = np.where(start >= 0, np.einsum("qd,qsd->qs", q, x[np.maximum(start, 0)]), -3).astype(np.float32)
    seen[rows, start] = True
    order = np.argsort(-sim, axis=1, kind="stable")[:, :width]
    ids, sim = np.take_along_axis(start, order, 1), np.take_along_axis(sim, order, 1)
    if ids.shape[1] < width:
        fill = ((0, 0), (0, width - ids.shape[1]))
        ids, sim = np.pad(ids, fill, constant_values=-1), np.pad(sim, fill, constant_values=-3)
    spent = ids < 0
    live = np.arange(q.shape[0])
    while live.size:
        score = np.where(spent[live], -4, sim[live])
        pick = np.argsort(-score, axis=1, kind="stable")[:, :EXPAND]
        good = np.take_along_axis(score, pick, 1) > -3
        nodes = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
        np.put_along_axis(s := spent[live], pick, True, 1)
        spent[live] = s
        near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(live.size, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        new = np.where(near >= 0, np.einsum("qd,qsd->qs", q[live], x[np.maximum(near, 0)]), -3).astype(np.float32)
        all_ids, all_sim = np.concatenate([ids[live], near], 1), np.concatenate([sim[live], new], 1)
        all_spent = np.concatenate([spent[live], near < 0], 1)
        order = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
        ids[live], sim[live], spent[live] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_sim, all_spent))
        live = live[~spent[live].all(1)]
    return ids, sim


def usable(table: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0)
    return table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("embedding")).where(F.coalesce(ok, F.lit(False)))


def build_index(table: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index, written to the shared folder: shard, dim, uri of its graph (flat arrays as one file of bounded size)."""
    rows = usable(table)
    rows = rows.dropDuplicates(["vec_id", "embedding"]) if _repeats(rows) else rows
    vec = F.col("embedding").cast("array<double>")
    # The largest component is worked out once a vector: an array of it alone binds its name.
    direction = F.transform(F.array(F.array_max(F.transform(vec, F.abs))), lambda most: F.transform(vec, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v / most).cast("float")))[0]
    keyed = rows.withColumn("unit", direction).select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("unit").alias("key"), F.xxhash64(F.lit(1), "unit").alias("key2"))
    # The limit by rank is taken before the shuffle too, so a vector that many rows have sends few of them.
    rank = F.row_number().over(Window.partitionBy("dim", "key", "key2").orderBy("vec_id"))
    kept = keyed.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    nodes = kept.groupBy("dim", "key", "key2").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("members"))
    nodes = shared.materialise(nodes, "vectors")
    per = nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row for each vector length
    if not per:
        return table.sparkSession.createDataFrame([], "shard bigint, dim int, uri string")
    shards = {r["dim"]: -(-r["n"] // shard_rows) for r in per}
    count = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("dim"))
    nodes = nodes.select("dim", F.pmod("key2", count).cast("bigint").alias("shard"), F.col("members.vec_id").alias("ids"), F.col("members.embedding").cast("array<array<double>>").alias("vectors"))
    folder = shared.new_folder(table.sparkSession, "index")

    def build(group: pa.Table) -> pa.Table:
        dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
        members = group["ids"].to_pylist()
        ids = np.full((len(members), k + 1), -1, np.int64)
        for i, own in enumerate(members):
            ids[i, :len(own)] = own
        flat = np.asarray(group["vectors"].combine_chunks().flatten().flatten(), np.float64).reshape(-1, dim)
        start = np.concatenate([[0], np.cumsum([len(own) for own in members])])
        order = np.argsort(ids[:, 0], kind="stable")
        ids, start = ids[order], start[:-1][order]
        at = np.repeat(np.arange(len(ids))[:, None], k + 1, 1)
        others = []
        for slot in range(1, k + 1):
            for i in np.flatnonzero(ids[:, slot] >= 0):
                if (flat[start[i] + slot] != flat[start[i]]).any():
                    at[i, slot] = len(ids) + len(others)
                    others.append(flat[start[i] + slot])
        vectors = np.concatenate([flat[start], np.array(others).reshape(-1, dim)])
        uri = f"{folder}/shard-{dim}-{shard}.npz"
        shared.write_atomically(uri, Graph.build(vectors, ids, at).dump())
        return pa.table({"shard": [shard], "dim": pa.array([dim], pa.int32()), "uri": [uri]})

    total = sum(shards.values())
    made = nodes.repartition(max(total, 1), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "shard bigint, dim int, uri string")
    return shared.materialise(made, "index-files")


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").head(1))


def _blocks(queries: DataFrame, block_bytes: int) -> tuple[str, int]:
    """Writes the queries as files of about block_bytes; the URI of a list of them (dim, uri), and how many there are."""
    spark = queries.sparkSession
    rows = usable(queries).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim")).distinct()
    rows = shared.materialise(rows, "queries")
    size = rows.agg(F.sum(F.col("dim") * F.lit(8))).first()[0] or 0
    folder = shared.new_folder(spark, "query-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            uri, own, data = f"{folder}/block-{part}-{made}.npz", held.pop(dim), io.BytesIO()
            np.savez(data, ids=np.array([x[0] for x in own], np.int64), vectors=np.stack([x[1] for x in own]))
            shared.write_atomically(uri, data.getvalue())
            made += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "uri": [uri]})

        for b in batches:
            for query, vec in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.asarray(vec.values, np.float64)
                held.setdefault(v.size, []).append((query, v))
                if len(held[v.size]) * v.size * 8 >= block_bytes:
                    yield out(v.size)
        for dim in sorted(held):
            yield out(dim)

    made = rows.select("vec_id", "embedding").repartition(max(1, -(-size // block_bytes)), "vec_id").mapInArrow(shared.lean(run), "dim int, uri string")
    found = sorted((r["dim"], r["uri"]) for r in shared.materialise(made, "blocks").collect())  # a name for each block
    shared.write_atomically(f"{folder}/list.json", json.dumps(found).encode())
    return f"{folder}/list.json", len(found)


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by largest cosine, ties to the smaller vec_id."""
    spark = index.sparkSession
    listed, blocks = _blocks(queries, block_bytes)
    shards = index.count()
    if not blocks or not shards:
        return spark.createDataFrame([], RESULT)
    # With few shards, several tasks share one, each with its part of the blocks.
    ways = min(blocks, max(1, spark.sparkContext.defaultParallelism // shards))
    work = index.select("dim", "uri", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("way")).repartition(shards * ways)
    found = work.mapInArrow(shared.lean(_searcher(listed, ways, k, beam)), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors counts by its nearest
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _load(uri: str) -> bytes:
    store, path = shared.filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read()


def _searcher(listed: str, ways: int, k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, uri, way in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = [u for d, u in json.loads(_load(listed)) if d == dim][way::ways]
                graph = Graph.load(_load(uri)) if mine else None
                for block in mine:
                    with np.load(io.BytesIO(_load(block))) as z:
                        ids, vectors = z["ids"], z["vectors"]
                    for a in range(0, ids.size, 512):
                        yield _nearest(graph, ids[a:a + 512], vectors[a:a + 512], k, beam)

    return run


def _nearest(graph: Graph, query: np.ndarray, vec: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    """The k nearest of each query in one shard, all nodes of the beam scored exactly."""
    node, _ = graph.search(vec, beam)
    qi, slot = np.nonzero(node >= 0)
    node = node[qi, slot]
    row, col = np.nonzero((graph.ids[node] >= 0) & (graph.ids[node] != query[qi][:, None]))
    q, node = qi[row], node[row]
    v, at = graph.ids[node, col], graph.at[node, col]
    s = np.concatenate([np.empty(0), *(cosine(vec[q[i:i + 8192]], graph.vectors[at[i:i + 8192]]) for i in range(0, q.size, 8192))])
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    nth = np.arange(q.size) - np.searchsorted(q, q)
    use = nth < k
    return pa.RecordBatch.from_arrays([pa.array(query[q[use]]), pa.array(v[use]), pa.array(s[use])], names=["query_id", "vec_id", "score"])


def nearest(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest other rows of every row whose vec_id is divisible by ``every``, against all rows."""
    return search(build_index(table, k), table.where(F.col("vec_id").cast("bigint") % every == 0), k)
