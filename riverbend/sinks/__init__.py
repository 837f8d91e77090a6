"""Sinks: merge tables on Parquet, JDBC databases, append-only stores, and key-value commands."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbend import types as L
from riverbend.operators.changes import DELETE, OP, UPSERT
from riverbend.sinks import writers
from riverbend.sources import JDBC, embedded, jdbc_options
from riverbend.storage import Files, connector

#: Databases that take upserts and deletes as statements.
STATEMENTS = ("postgres", "cockroachdb", "mysql", "mariadb", "sqlite")


class SinkError(ValueError):
    """A sink that can't take what a flow gives it."""


@dataclass(frozen=True)
class Conflict:
    """What happens to a row whose key exists: ``ignore`` keeps the existing one, ``overwrite`` replaces it."""

    key: tuple[str, ...]
    strategy: str = "overwrite"

    def __post_init__(self):
        if not self.key or any(not k.strip() for k in self.key):
            raise SinkError("a conflict needs key columns")
        if self.strategy not in ("ignore", "overwrite"):
            raise SinkError(f"unknown conflict strategy {self.strategy!r}")


@dataclass(frozen=True)
class Report:
    upserts: int
    deletes: int
    skipped: int = 0


def merged(existing: DataFrame, batch: DataFrame, conflict: Conflict) -> DataFrame:
    """existing after the batch (tagged by ``_op``): upserts by key and strategy first, then deletes. One pass over each side, joined by
    key; of a batch's rows with one key, an arbitrary one counts."""
    key = list(conflict.key)
    rows = batch if OP in batch.columns else batch.withColumn(OP, F.lit(UPSERT))
    upserts = rows.where(F.col(OP) == UPSERT).drop(OP).dropDuplicates(key)
    deletes = rows.where(F.col(OP) == DELETE).select(*key).distinct()
    if conflict.strategy == "ignore" or set(key) == set(existing.columns):
        out = existing.unionByName(upserts.join(existing.select(*key), key, "left_anti").select(*existing.columns))
    else:
        out = existing.join(upserts.select(*key), key, "left_anti").select(*existing.columns).unionByName(upserts)
    return out.join(deletes, key, "left_anti").select(*existing.columns)


#: A file of this name and a batch's number lists the batches it stands for.
_FOLDED = "folded="


class MergeTable:
    """A Parquet table that is written by adding batches and read by merging them: a write costs what its batch costs, at any table size.

    Batches are folders named by id, so a repeated write replaces itself; ``compact`` folds them into one. With a conflict rule, reading
    takes the last (or first) upsert of each key after its last delete, as an aggregate that is combined before the shuffle.
    """

    SEQUENCE = "_seq"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, conflict: Conflict | None = None):
        self.spark, self.path, self.schema, self.conflict = spark, path.rstrip("/"), schema, conflict
        self.files = Files(spark, self.path)
        missing = [k for k in (conflict.key if conflict else ()) if k not in schema.names]
        if missing:
            raise SinkError(f"conflict key columns {missing} are not in the sink")

    def batches(self) -> list[str]:
        """The whole batches, without those that a whole batch stands for."""
        whole, folded = self._state()
        return [n for n in whole if n not in folded]

    def _state(self) -> tuple[list[str], set[str]]:
        names = self.files.names()
        whole = [n for n in names if n.startswith("batch=") and self.files.exists(f"{n}/_SUCCESS")]
        return whole, {old for n in names if n.startswith(_FOLDED) and f"batch={n.removeprefix(_FOLDED)}" in whole for old in (self.files.read(n) or "").split("\n")}

    def next_id(self) -> int:
        return max((int(n.split("=")[1]) for n in self.files.names() if n.startswith("batch=") or n.startswith(_FOLDED)), default=-1) + 1

    def write(self, batch: DataFrame, batch_id: int | None = None) -> Report:
        number = self.next_id() if batch_id is None else batch_id
        rows = batch if OP in batch.columns else batch.withColumn(OP, F.lit(UPSERT))
        names = self.schema.names
        absent = {n: F.lit(None).cast(self.schema[n].dataType) for n in names if n not in rows.columns}
        rows = rows.withColumns(absent).select(*[F.col(f"`{n}`") for n in names], OP)
        if self.conflict is None:
            rows = rows.where(F.col(OP) == UPSERT)
        # Within a batch upserts come before deletes.
        rows = rows.withColumn(self.SEQUENCE, F.struct(F.lit(number).cast("bigint").alias("batch"), (F.col(OP) == DELETE).cast("int").alias("last"), F.monotonically_increasing_id().alias("row")))
        seen = f"{self.path}/batch={number:012d}"
        rows.write.mode("overwrite").parquet(seen)
        done = self.spark.read.parquet(seen).groupBy(OP).count().collect()
        count = {r[OP]: r["count"] for r in done}
        return Report(count.get(UPSERT, 0), count.get(DELETE, 0))

    def read(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.parquet(*[f"{self.path}/{n}" for n in found])
        if self.conflict is None:
            return rows.select(*self.schema.names)
        key, whole = list(self.conflict.key), F.struct(*rows.columns)
        if self.conflict.strategy == "overwrite":
            kept = rows.groupBy(*key).agg(F.max_by(whole, self.SEQUENCE).alias("r"))
        else:
            gone = F.max(F.when(F.col(OP) == DELETE, F.col(self.SEQUENCE))).over(Window.partitionBy(*key))
            alive = rows.withColumn("_gone", gone).where((F.col(OP) == UPSERT) & (F.col("_gone").isNull() | (F.col(self.SEQUENCE) > F.col("_gone")))).drop("_gone")
            kept = alive.groupBy(*key).agg(F.min_by(whole, self.SEQUENCE).alias("r"))
        return kept.where(F.col(f"r.{OP}") == UPSERT).select(*[F.col(f"r.`{n}`").alias(n) for n in self.schema.names])

    def compact(self) -> None:
        """Folds all batches into one under a new id; the old ones are removed after it is whole.

        The new batch names those it stands for before it is complete, and readers leave these out from then on: a compaction that stops
        halfway neither doubles nor loses rows, and the next one removes what is left.
        """
        found = self.batches()
        if len(found) > 1:
            number = self.next_id()
            self.files.write(f"{_FOLDED}{number:012d}", "\n".join(found))
            self.write(self.read(), number)
        whole, folded = self._state()
        for n in whole:
            if n in folded:
                self.files.delete(n)


@dataclass(frozen=True)
class Sink:
    name: str
    kind: str
    config: Mapping[str, Any] = field(default_factory=dict)
    options: Mapping[str, Any] = field(default_factory=dict)

    def schema(self, spark: SparkSession, table: str) -> T.StructType | None:
        """The declared columns (``columns`` by table, as DDL), or a database's; None where the sink takes any."""
        ddl = (self.config.get("columns") or {}).get(table)
        if ddl:
            return T.StructType.fromDDL(ddl)
        if self.kind in JDBC and not ("connect" in self.config or str(self.config.get("url", "")).startswith("http")):
            return spark.read.format("jdbc").options(**jdbc_options(self.kind, self.config, table)).load().schema
        return None

    def check(self, columns: Sequence[str], conflict: Conflict | None) -> None:
        """What a kind of sink demands of a flow."""
        if self.kind in ("clickhouse", "questdb", "redis") and conflict is not None:
            raise SinkError(f"{self.name}: a {self.kind} sink takes no conflict rule")
        if self.kind == "questdb" and self.config.get("timestamp") not in columns:
            raise SinkError(f"{self.name}: a questdb sink needs its designated timestamp among the columns")
        if self.kind == "redis":
            commands(self.options.get("mode", "kv"), columns)
        if self.kind == "mongodb" and set(self.options) <= {"root"}:
            if self.options and self.options["root"] not in columns:
                raise SinkError(f"{self.name}: the root document {self.options['root']!r} is not among the columns")
        elif self.options and self.kind != "redis":
            raise SinkError(f"{self.name}: a {self.kind} sink takes no options per flow")

    def write(self, batch: DataFrame, table: str, conflict: Conflict | None = None, batch_id: int | None = None, schema: T.StructType | None = None, client: Callable | None = None) -> Report:
        if self.kind == "parquet":
            plain = T.StructType([f for f in batch.schema.fields if f.name != OP])
            return MergeTable(batch.sparkSession, f"{self.config['path'].rstrip('/')}/{table}", schema or plain, conflict).write(batch, batch_id)
        if self.kind == "redis":
            return send(batch, self.options.get("mode", "kv"), table, client or self.config["client"])
        rows = writers.plain(writers.tagged(batch))
        columns = [c for c in rows.columns if c != OP]
        key = list(conflict.key) if conflict else []
        dealt = writers.by_key(rows, key) if key else rows
        if self.kind == "mongodb":
            given = client or self.config.get("client") or partial(writers.BulkClient, self.config.get("url", ""), self.config.get("database", ""))
            return Report(*writers.per_partition(dealt, writers.documents_writer(table, key, conflict.strategy if conflict else None, columns, self.options.get("root"), given)))
        if self.kind == "clickhouse" and str(self.config.get("url", "")).startswith(("http://", "https://")):
            types = [(f.name, L.logical_type(f.dataType, f.metadata), f.nullable) for f in (schema or batch.schema).fields if f.name in columns]
            head = writers.credentials(self.config.get("user"), self.config.get("password"))
            kept = rows.where(F.col(OP) != DELETE).select(*[F.col(f"`{n}`") for n, _, _ in types])
            return Report(*writers.per_partition(kept, writers.http_writer(self.config["url"], table, types, head)))
        if self.kind in STATEMENTS and (conflict is not None or "connect" in self.config or self.kind == "sqlite"):
            upsert, delete = statements(self.kind, table, columns, conflict)
            return Report(*writers.per_partition(dealt, writers.statements_writer(upsert, delete, columns, key, connector(self.kind, self.config))))
        if self.kind in JDBC:
            options, kept = jdbc_options(self.kind, self.config, table), rows.where(F.col(OP) != DELETE).drop(OP)
            if embedded.driver_only(batch.sparkSession, options["url"]):
                return Report(embedded.append(kept, options), 0)
            seen = Observation()
            kept.observe(seen, F.count(F.lit(1)).alias("n")).write.format("jdbc").options(**options).mode("append").save()
            return Report(int(seen.get["n"]), 0)
        raise SinkError(f"{self.name}: unknown kind {self.kind!r}")

    def dry_run(self, batch: DataFrame, rows: int = 100) -> None:
        """Plans, checks types and runs a few rows; writes nothing."""
        batch.limit(rows).write.format("noop").mode("overwrite").save()


def statements(kind: str, table: str, columns: Sequence[str], conflict: Conflict | None) -> tuple[str, str | None]:
    """(upsert, delete by key) of a database with ? parameters, for a writer that runs them per partition."""
    tick = "`" if kind in ("mysql", "mariadb") else '"'
    q = lambda n: ".".join(f"{tick}{p.replace(tick, tick * 2)}{tick}" for p in n.split("."))
    marks = ", ".join("?" for _ in columns)
    names = ", ".join(q(c) for c in columns)
    insert = f"INSERT INTO {q(table)} ({names}) VALUES ({marks})"
    if conflict is None:
        return insert, None
    rest = [c for c in columns if c not in conflict.key]
    where = " AND ".join(f"{q(k)} = ?" for k in conflict.key)
    keep = conflict.strategy == "ignore" or not rest
    if tick == "`":
        upsert = insert.replace("INSERT", "INSERT IGNORE", 1) if keep else f"{insert} ON DUPLICATE KEY UPDATE " + ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest)
    else:
        target = f"{insert} ON CONFLICT ({', '.join(q(k) for k in conflict.key)}) DO "
        upsert = target + ("NOTHING" if keep else "UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest))
    return upsert, f"DELETE FROM {q(table)} WHERE {where}"


# Columns each key-value mode needs and may have; fixed values.
_CONTRACT = {"kv": (("key", "value"), ("ttl",)), "kv-delete": (("key",), ()), "list": (("value",), ("key",)), "stream": (("key", "value"), ()), "pubsub": (("value",), ("key",))}
_VERB = {"kv": "SET", "kv-delete": "DEL", "list": "RPUSH", "stream": "XADD", "pubsub": "PUBLISH"}


def commands(mode: str, columns: Sequence[str]) -> tuple[str, ...]:
    """The mode's columns, checked: every needed one and no other."""
    if mode not in _CONTRACT:
        raise SinkError(f"unknown key-value mode {mode!r}")
    must, may = _CONTRACT[mode]
    given = [c for c in columns if c != OP]
    if any(c not in given for c in must) or any(c not in (*must, *may) for c in given):
        raise SinkError(f"mode {mode} takes the columns {', '.join(must)}" + (f" and optionally {', '.join(may)}" if may else ""))
    return must + may


def command_rows(batch: DataFrame, mode: str, prefix: str) -> DataFrame:
    """One command per row as an array of texts: verb, prefixed key, JSON value, expiry in milliseconds. Deletes become DEL in kv mode."""
    commands(mode, batch.columns)
    kinds = {f.name: L.logical_type(f.dataType, f.metadata).kind for f in batch.schema.fields}
    key = F.concat(F.lit(prefix), F.coalesce(F.col("key").cast("string"), F.lit(""))) if "key" in kinds else F.lit(prefix)
    empty = F.array().cast("array<string>")
    value: Column = empty
    if "value" in kinds and mode != "kv-delete":
        body = F.to_json("value") if kinds["value"] in ("Json", "Object", "Array") else F.to_json(F.col("value").cast("variant"))
        value = F.array(F.lit("*"), F.lit("data"), body) if mode == "stream" else F.array(body)
    ttl = F.when(F.col("ttl").isNotNull(), F.array(F.lit("PX"), F.floor(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.col("ttl")) / 1000).cast("string"))).otherwise(empty) if "ttl" in kinds and mode == "kv" else empty
    out = F.concat(F.array(F.lit(_VERB[mode]), key), value, ttl)
    if OP in batch.columns and mode == "kv":
        out = F.when(F.col(OP) == DELETE, F.array(F.lit("DEL"), key)).otherwise(out)
    return batch.select(out.alias("command"))


def send(batch: DataFrame, mode: str, prefix: str, client: Callable[[], Any]) -> Report:
    """Runs the commands from the executors, one client per partition; ``client()`` gives an object with execute(list of commands)."""

    def run(rows: Iterator[dict]) -> tuple[int, int, int]:
        target, done = client(), 0
        for some in writers.chunks((list(r["command"]) for r in rows), writers.CHUNK):
            target.execute(some)
            done += len(some)
        return done, 0, 0

    return Report(*writers.per_partition(command_rows(batch, mode, prefix), run))
