"""Small shared state: cursors by flow, in files through Hadoop's file systems (wherever Spark's paths work) or in a database."""

from __future__ import annotations

import datetime as dt
import decimal
import importlib
import json
import re
import sys
from collections.abc import Callable, Mapping
from functools import partial
from typing import Any, Protocol
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a new file is renamed over the old one's place."""
        part = self._path(f"{name}.part")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self._path(name), False)
        self.fs.rename(part, self._path(name))


_TAGS = {dt.datetime: ("timestamp", lambda v: v.isoformat()), dt.date: ("date", lambda v: v.isoformat()), decimal.Decimal: ("decimal", str), bytes: ("bytes", bytes.hex), bytearray: ("bytes", bytes.hex)}
_BACK = {"timestamp": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "decimal": decimal.Decimal, "bytes": bytes.fromhex}


def encode(cursor: tuple) -> str:
    def one(v: Any) -> Any:
        if type(v) in _TAGS:
            kind, how = _TAGS[type(v)]
            return {"type": kind, "value": how(v)}
        return v

    return json.dumps({"cursor": [one(v) for v in cursor]})


def decode(text: str) -> tuple:
    return tuple(_BACK[v["type"]](v["value"]) if isinstance(v, dict) else v for v in json.loads(text)["cursor"])


class Store(Protocol):
    """Where flows keep their cursors."""

    def load(self, flow: str) -> tuple | None: ...

    def save(self, flow: str, cursor: tuple) -> None: ...


class CursorStore:
    """The last committed cursor of each flow, as tagged JSON files."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def load(self, flow: str) -> tuple | None:
        for name in (f"{flow}.json", f"{flow}.json.part"):
            text = self.files.read(name)
            if text:
                return decode(text)
        return None

    def save(self, flow: str, cursor: tuple) -> None:
        self.files.write(f"{flow}.json", encode(cursor))


class SqlStore:
    """Cursors in a table of a database: one row for each flow, replaced in a transaction. connect gives a DB-API connection."""

    def __init__(self, connect: Callable[[], Any], table: str = "riverbend_cursors"):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", table):
            raise ValueError(f"{table!r} is no table name")
        self.connect, self.table = connect, table
        self._run(lambda c, mark: c.execute(f"CREATE TABLE IF NOT EXISTS {table} (flow VARCHAR(255) PRIMARY KEY, value TEXT NOT NULL)"))

    def _run(self, work: Callable[[Any, str], Any]) -> Any:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            out = work(cursor, placeholder(connection))
            connection.commit()
            return out
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def load(self, flow: str) -> tuple | None:
        def work(c: Any, mark: str) -> tuple | None:
            c.execute(f"SELECT value FROM {self.table} WHERE flow = {mark}", (flow,))
            return c.fetchone()

        found = self._run(work)
        return decode(found[0]) if found else None

    def save(self, flow: str, cursor: tuple) -> None:
        def work(c: Any, mark: str) -> None:
            c.execute(f"DELETE FROM {self.table} WHERE flow = {mark}", (flow,))
            c.execute(f"INSERT INTO {self.table} (flow, value) VALUES ({mark}, {mark})", (flow, encode(cursor)))

        self._run(work)


class DocumentStore:
    """Cursors as documents {_id: flow, value}. client gives an object with find_one(filter) and replace_one(filter, document, upsert)."""

    def __init__(self, client: Callable[[], Any]):
        self.client = client

    def load(self, flow: str) -> tuple | None:
        found = self.client().find_one({"_id": flow})
        return decode(found["value"]) if found else None

    def save(self, flow: str, cursor: tuple) -> None:
        self.client().replace_one({"_id": flow}, {"_id": flow, "value": encode(cursor)}, upsert=True)


# Modules by kind of database that can be there, in the order they are tried; fixed values.
_MODULES = {"postgres": ("psycopg", "psycopg2"), "cockroachdb": ("psycopg", "psycopg2"), "questdb": ("psycopg", "psycopg2"), "mysql": ("pymysql", "MySQLdb"), "mariadb": ("pymysql", "MySQLdb"), "sqlite": ("sqlite3",)}


def named(name: str) -> Callable:
    """The function that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def connector(kind: str, config: Mapping[str, Any]) -> Callable[[], Any]:
    """A function that gives a DB-API connection, on the driver or an executor: ``connect`` of the configuration (a function, or
    module:function that takes the configuration), else one of the kind's modules."""
    given = config.get("connect")
    if callable(given):
        return given
    if given:
        return partial(_call, given, dict(config))
    if kind not in _MODULES:
        raise ValueError(f"no connection to a {kind}")
    return partial(_connect, kind, str(config.get("url", "")))


def _call(name: str, config: dict[str, Any]) -> Any:
    return named(name)(config)


def _connect(kind: str, url: str) -> Any:
    for name in _MODULES[kind]:
        try:
            module = importlib.import_module(name)
        except ModuleNotFoundError:
            continue
        if name in ("pymysql", "MySQLdb"):
            u = urlsplit(url)
            return module.connect(host=u.hostname, port=u.port or 3306, user=u.username, password=u.password or "", database=u.path.lstrip("/"))
        return module.connect(url.removeprefix("sqlite://") if kind == "sqlite" else url)
    raise ModuleNotFoundError(f"a {kind} needs one of {', '.join(_MODULES[kind])}")


def placeholder(connection: Any) -> str:
    """The parameter mark of a connection's module."""
    module = sys.modules.get(type(connection).__module__.partition(".")[0])
    return "?" if getattr(module, "paramstyle", "format") == "qmark" else "%s"


def open_store(spark: SparkSession, kind: str, config: Mapping[str, Any], flow_state: str | None = None) -> Store:
    """The cursor store of a configured storage; flow_state is a folder that takes its place."""
    if flow_state is not None or kind in ("parquet", "files"):
        return CursorStore(spark, f"{(flow_state or config['path']).rstrip('/')}/cursors")
    if kind == "mongodb":
        return DocumentStore(config["client"] if callable(config.get("client")) else partial(_call, config["client"], dict(config)))
    return SqlStore(connector(kind, config), config.get("table", "riverbend_cursors"))
