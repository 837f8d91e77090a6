"""Writers that run on the executors: statements of a database, operations of a document store, rows over HTTP, key-value commands.

Each takes a batch's partitions one by one, once: what a task wrote is counted by the task and added up.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import importlib
import ipaddress
import json
import struct
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbend import types as L
from riverbend.operators.changes import DELETE, OP, UPSERT
from riverbend.storage import placeholder

#: Rows that one statement, bulk operation or request takes.
CHUNK = 1000


def tagged(batch: DataFrame) -> DataFrame:
    return batch if OP in batch.columns else batch.withColumn(OP, F.lit(UPSERT))


def plain(batch: DataFrame) -> DataFrame:
    """JSON columns as text, since Arrow does not carry variants."""
    return batch.withColumns({f.name: F.to_json(F.col(f"`{f.name}`")) for f in batch.schema.fields if isinstance(f.dataType, T.VariantType)})


def by_key(batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of one key in one partition, upserts before deletes: no two tasks change one row, and order within a key is kept."""
    return batch.repartition(*[F.col(f"`{k}`") for k in key]).sortWithinPartitions(F.col(OP) == DELETE)


def per_partition(batch: DataFrame, work: Callable[[Iterator[dict[str, Any]]], tuple[int, int, int]]) -> tuple[int, int, int]:
    """work's (upserts, deletes, skipped) of all partitions, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = work(row for b in batches for row in b.to_pylist())
        yield pa.RecordBatch.from_pydict(dict(zip(("u", "d", "s"), ([int(n)] for n in counts), strict=True)))

    total = batch.mapInArrow(run, "u bigint, d bigint, s bigint").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("u", "d", "s")]).first()
    return tuple(total)


def chunks(rows: Iterator[Any], size: int) -> Iterator[list[Any]]:
    held: list[Any] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def statements_writer(upsert: str, delete: str | None, columns: Sequence[str], key: Sequence[str], connect: Callable[[], Any]) -> Callable[[Iterator[dict]], tuple[int, int, int]]:
    """Runs the statements (with ? parameters) in one transaction for each partition; rows come with upserts first."""

    def work(rows: Iterator[dict]) -> tuple[int, int, int]:
        done = [0, 0, 0]
        connection = connect()
        try:
            cursor, mark = connection.cursor(), placeholder(connection)
            for some in chunks(rows, CHUNK):
                for gone in (False, True):
                    own = [r for r in some if (r[OP] == DELETE) == gone]
                    if gone and delete is None:
                        done[2] += len(own)
                    elif own:
                        cursor.executemany((delete if gone else upsert).replace("?", mark), [tuple(r[c] for c in (key if gone else columns)) for r in own])
                        done[gone] += len(own)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()
        return tuple(done)

    return work


def operations(row: dict[str, Any], key: Sequence[str], strategy: str | None, columns: Sequence[str], root: str | None) -> tuple:
    """The document store's operation of one row: (insert, document), (insert-new, filter, document), (replace, filter, document) or (delete, filter)."""
    document = json.loads(row[root]) if root else {c: row[c] for c in columns}
    if root:
        document |= {c: row[c] for c in columns if c != root}
    where = {k: row[k] for k in key}
    if row[OP] == DELETE:
        return ("delete", where)
    return ("insert", document) if strategy is None else ("insert-new" if strategy == "ignore" else "replace", where, document)


def documents_writer(collection: str, key: Sequence[str], strategy: str | None, columns: Sequence[str], root: str | None, client: Callable[[], Any]) -> Callable[[Iterator[dict]], tuple[int, int, int]]:
    """client gives an object with bulk(collection, operations), which says how many of them changed nothing."""

    def work(rows: Iterator[dict]) -> tuple[int, int, int]:
        target, done = client(), [0, 0, 0]
        for some in chunks((r for r in rows if r[OP] != DELETE or key), CHUNK):
            made = [operations(r, key, strategy, columns, root) for r in some]
            skipped = int(target.bulk(collection, made) or 0)
            gone = sum(o[0] == "delete" for o in made)
            done[0] += len(made) - gone - skipped
            done[1] += gone
            done[2] += skipped
        return tuple(done)

    return work


class BulkClient:
    """Operations on a database of the pymongo module, where it is installed."""

    def __init__(self, url: str, database: str):
        self.module = importlib.import_module("pymongo")
        self.database = self.module.MongoClient(url)[database]

    def bulk(self, collection: str, made: list[tuple]) -> int:
        m = self.module
        kinds = {
            "insert": lambda o: m.InsertOne(o[1]), "replace": lambda o: m.ReplaceOne(o[1], o[2], upsert=True), "delete": lambda o: m.DeleteOne(o[1]),
            "insert-new": lambda o: m.UpdateOne(o[1], {"$setOnInsert": o[2]}, upsert=True),
        }
        result = self.database[collection].bulk_write([kinds[o[0]](o) for o in made], ordered=True)
        new = sum(o[0] == "insert-new" for o in made)
        return new - result.upserted_count if new else 0


# Row format of the column store ---------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


_PACKED = {"Int8": "<b", "Int16": "<h", "Int32": "<i", "Int64": "<q", "UInt8": "<B", "UInt16": "<H", "UInt32": "<I", "UInt64": "<Q", "Float32": "<f", "Float64": "<d"}
_EPOCH = dt.date(1970, 1, 1)


def binary_value(v: Any, t: L.Type) -> bytes:
    """One value without its null flag: integers and floats little-endian, texts with their length, decimals scaled, dates as days."""
    kind = t.kind
    if kind in _PACKED:
        return struct.pack(_PACKED[kind], v)
    if kind == "Bool":
        return b"\x01" if v else b"\x00"
    if kind in ("Text", "Json", "Xml", "Object"):
        raw = (v if isinstance(v, str) else json.dumps(v)).encode()
        return _varint(len(raw)) + raw
    if kind == "Bytes":
        return bytes(v) if t.size is not None and len(v) == t.size else _varint(len(v)) + bytes(v)
    if kind == "Date":
        return struct.pack("<H", (v - _EPOCH).days)
    if kind == "Timestamp":
        at = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return struct.pack("<I", int(at.timestamp()))
    if kind in ("Decimal", "BigInt"):
        digits = t.precision or t.size or 38
        scaled = int(decimal.Decimal(v).scaleb(t.scale or 0, decimal.Context(prec=80)))
        return scaled.to_bytes(4 if digits <= 9 else 8 if digits <= 18 else 16, "little", signed=True)
    if kind == "Uuid":
        raw = uuid.UUID(v).bytes
        return raw[7::-1] + raw[:7:-1]
    if kind == "Ipv4":
        return int(ipaddress.IPv4Address(v)).to_bytes(4, "little")
    if kind == "Ipv6":
        return ipaddress.IPv6Address(v).packed
    if kind == "Array":
        return _varint(len(v)) + b"".join(nullable_value(x, t.element, t.element_nullable) for x in v)
    raise ValueError(f"{t} has no row format")


def nullable_value(v: Any, t: L.Type, nullable: bool) -> bytes:
    if not nullable:
        if v is None:
            raise ValueError("a null in a column that takes none")
        return binary_value(v, t)
    return b"\x01" if v is None else b"\x00" + binary_value(v, t)


def http_writer(url: str, table: str, columns: Sequence[tuple[str, L.Type, bool]], headers: dict[str, str], timeout: float = 60.0) -> Callable[[Iterator[dict]], tuple[int, int, int]]:
    """Appends rows over HTTP, one request for each chunk."""
    names = ", ".join("`" + n.replace("`", "\\`") + "`" for n, _, _ in columns)
    target = ".".join(f"`{p}`" for p in table.split("."))

    def work(rows: Iterator[dict]) -> tuple[int, int, int]:
        done = 0
        for some in chunks(rows, 10 * CHUNK):
            body = b"".join(nullable_value(r[n], t, null) for r in some for n, t, null in columns)
            query = f"INSERT INTO {target} ({names}) FORMAT RowBinary"
            request = urllib.request.Request(f"{url}{'&' if '?' in url else '?'}query={urllib.request.quote(query)}", body, headers | {"Content-Type": "application/octet-stream"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                answer.read()
            done += len(some)
        return done, 0, 0

    return work


def credentials(user: str | None, password: str | None) -> dict[str, str]:
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode()} if user else {}
