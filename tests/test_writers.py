import datetime as dt
import decimal
import io
import sqlite3
import struct
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.plans import config
from riverbend.plans.flow import Runner
from riverbend.sinks import Conflict, Sink, SinkError, writers
from riverbend.sources import Source
from riverbend.storage import DocumentStore, SqlStore, open_store

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def rows(path, sql):
    c = sqlite3.connect(path)
    try:
        return c.execute(sql).fetchall()
    finally:
        c.close()


@pytest.mark.parametrize(("strategy", "want"), [("overwrite", {1: "A", 2: "b", 4: "D"}), ("ignore", {1: "a", 2: "b", 4: "D"})])
def test_upserts_and_deletes_of_a_database(spark, tmp_path, strategy, want):
    path = str(tmp_path / "x.db")
    rows(path, "CREATE TABLE t (k INTEGER, part TEXT, v TEXT, PRIMARY KEY (k, part))")
    sink, rule = Sink("s", "sqlite", {"url": path}), Conflict(("k", "part"), strategy)
    assert sink.write(spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "p", "c")], "k int, part string, v string").coalesce(1), "t", rule).upserts == 3
    batch = spark.createDataFrame([(3, "p", None, "D"), (1, "p", "A", "U"), (4, "p", "D", "U"), (9, "p", None, "D")], "k int, part string, v string, _op string").coalesce(1)
    for _ in range(2):  # a replayed batch changes nothing
        report = sink.write(batch, "t", rule)
        assert (report.upserts, report.deletes) == (2, 2)
        assert dict(rows(path, "SELECT k, v FROM t")) == want


def test_a_failing_partition_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "x.db")
    rows(path, "CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT NOT NULL)")
    with pytest.raises(Exception):
        Sink("s", "sqlite", {"url": path}).write(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").coalesce(1), "t")
    assert rows(path, "SELECT * FROM t") == []


class Documents:
    """A document database in a file, for all processes of a test."""

    def __init__(self, path):
        self.c = sqlite3.connect(path)
        self.c.execute("CREATE TABLE IF NOT EXISTS ops (collection TEXT, op TEXT)")

    def bulk(self, collection, made):
        self.c.executemany("INSERT INTO ops VALUES (?, ?)", [(collection, repr(o)) for o in made])
        self.c.commit()
        return sum(o[0] == "insert-new" and o[1]["k"] == 1 for o in made)


@pytest.mark.parametrize(("conflict", "options", "want"), [
    (None, {}, [("insert", {"k": 1, "body": '{"x":5}'}), ("insert", {"k": 2, "body": None})]),
    (Conflict(("k",)), {}, [("replace", {"k": 1}, {"k": 1, "body": '{"x":5}'}), ("replace", {"k": 2}, {"k": 2, "body": None}), ("delete", {"k": 3})]),
    (Conflict(("k",), "ignore"), {}, [("insert-new", {"k": 1}, {"k": 1, "body": '{"x":5}'}), ("insert-new", {"k": 2}, {"k": 2, "body": None}), ("delete", {"k": 3})]),
])
def test_operations_of_a_document_store(spark, tmp_path, conflict, options, want):
    path = str(tmp_path / "d.db")
    df = spark.createDataFrame([(3, None, "D"), (1, '{"x": 5}', "U"), (2, None, "U")], "k int, body string, _op string").withColumn("body", F.parse_json("body"))
    report = Sink("m", "mongodb", {"client": lambda: Documents(path)}, options).write(df.coalesce(1), "c", conflict)
    assert sorted(o for (o,) in rows(path, "SELECT op FROM ops WHERE collection = 'c'")) == sorted(map(repr, want))
    skipped = int(conflict is not None and conflict.strategy == "ignore")
    assert (report.upserts, report.deletes, report.skipped) == (2 - skipped, int(conflict is not None), skipped)


def test_a_whole_row_as_root_document():
    row = {"_id": 7, "body": '{"name": "n", "deep": {"a": [1]}}', "_op": "U"}
    assert writers.operations(row, ["_id"], "overwrite", ["_id", "body"], "body") == ("replace", {"_id": 7}, {"name": "n", "deep": {"a": [1]}, "_id": 7})
    with pytest.raises(SinkError):
        Sink("m", "mongodb", {}, {"root": "nope"}).check(["_id"], None)


def test_key_value_commands_run_once(spark, tmp_path):
    path = str(tmp_path / "k.db")

    class Client:
        def execute(self, commands):
            c = sqlite3.connect(path)
            c.execute("CREATE TABLE IF NOT EXISTS ops (op TEXT)")
            c.executemany("INSERT INTO ops VALUES (?)", [("|".join(x),) for x in commands])
            c.commit()
            c.close()

    df = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string").coalesce(1)
    assert Sink("r", "redis", {"client": Client}).write(df, "p:").upserts == 2
    assert sorted(rows(path, "SELECT op FROM ops")) == [('SET|p:a|"1"',), ('SET|p:b|"2"',)]


def test_jdbc_source_and_append(spark, tmp_path):
    """A real database, embedded: rows are appended over JDBC and read back by cursor, with the range pushed to the database."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(i, f"n{i}", decimal.Decimal(i) / 4) for i in range(20)], "id bigint, name string, price decimal(10,2)")
    df.limit(0).write.format("jdbc").options(url=url, dbtable="items", **DERBY).save()
    made = {"url": url, **DERBY}
    assert Sink("d", "postgres", made).write(df, "items").upserts == 20
    source = Source("d", "postgres", made | {"partition-column": "id", "lower-bound": 0, "upper-bound": 20, "partitions": 3})
    from riverbend.operators import keyset

    got = keyset.scan(source.read(spark, "items"), ["id"], (11,), True, 4)
    assert [(r["id"], r["name"], str(r["price"])) for r in got.orderBy("id").collect()] == [(i, f"n{i}", f"{i / 4:.2f}") for i in range(12, 16)]
    assert "GREATERTHANOREQUAL(ID,11)" in got._jdf.queryExecution().executedPlan().toString().upper()


def varint(f):
    n = shift = 0
    while True:
        b = f.read(1)[0]
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n


def test_rows_over_http(spark):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((parse_qs(urlsplit(self.path).query), self.headers.get("Authorization"), self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        sink = Sink("ch", "clickhouse", {"url": f"http://127.0.0.1:{server.server_address[1]}/?database=d", "user": "u", "password": "p", "columns": {"t": "id bigint not null, name string, day date not null, at timestamp not null, price decimal(10,2) not null, tags array<string> not null"}})
        df = spark.createDataFrame([(1, "é", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc), decimal.Decimal("-1.25"), ["a", "b"], "U"), (2, None, dt.date(1970, 1, 2), dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), decimal.Decimal("7"), [], "U"), (3, "gone", None, None, None, None, "D")],
                                   "id bigint, name string, day date, at timestamp, price decimal(10,2), tags array<string>, _op string").coalesce(1)
        assert sink.write(df, "t", schema=sink.schema(spark, "t")).upserts == 2
    finally:
        server.shutdown()
    (query, auth, body), = got
    assert query["query"][0] == "INSERT INTO `t` (`id`, `name`, `day`, `at`, `price`, `tags`) FORMAT RowBinary" and query["database"] == ["d"] and auth.startswith("Basic ")
    f = io.BytesIO(body)
    text = lambda: f.read(varint(f)).decode()
    out = []
    while f.tell() < len(body):
        i = struct.unpack("<q", f.read(8))[0]
        name = None if f.read(1) == b"\x01" else text()
        day, at, price = struct.unpack("<H", f.read(2))[0], struct.unpack("<I", f.read(4))[0], struct.unpack("<q", f.read(8))[0]
        tags = [None if f.read(1) == b"\x01" else text() for _ in range(varint(f))]
        out.append((i, name, day, at, price, tags))
    assert out == [(1, "é", 19724, 1704164645, -125, ["a", "b"]), (2, None, 1, 0, 700, [])]


def test_row_values():
    cases = [(L.BOOL, True, b"\x01"), (L.UINT8, 200, b"\xc8"), (L.INT16, -2, b"\xfe\xff"), (L.FLOAT32, 1.5, struct.pack("<f", 1.5)), (L.UUID, "00112233-4455-6677-8899-aabbccddeeff", bytes.fromhex("7766554433221100ffeeddccbbaa9988")), (L.IPV4, "10.0.0.1", b"\x01\x00\x00\x0a"),
             (L.decimal(38, 3), decimal.Decimal("12345678901234567890.123"), (12345678901234567890123).to_bytes(16, "little")), (L.Type("Bytes", size=2), b"ab", b"ab"), (L.BYTES, b"ab", b"\x02ab"), (L.TEXT, "x" * 200, b"\xc8\x01" + b"x" * 200)]
    assert [writers.binary_value(v, t) for t, v, _ in cases] == [w for _, _, w in cases]
    with pytest.raises(ValueError):
        writers.nullable_value(None, L.TEXT, False)


def test_cursors_in_databases(spark, tmp_path):
    class Collection(dict):
        def find_one(self, where):
            return self.get(where["_id"])

        def replace_one(self, where, document, upsert):
            self[where["_id"]] = document

    held = Collection()
    url = str(tmp_path / "c.db")
    for store in (SqlStore(lambda: sqlite3.connect(url)), DocumentStore(lambda: held), open_store(spark, "sqlite", {"url": url, "table": "marks"}), open_store(spark, "files", {"path": str(tmp_path / "f")})):
        assert store.load("a") is None
        for cursor in ((1, None, "x"), (dt.datetime(2024, 1, 2, 3, 4, 5, 6, dt.timezone.utc), decimal.Decimal("1.50"), b"\x00")):
            store.save("a", cursor)
            store.save("b", (2,))
            assert store.load("a") == cursor and store.load("b") == (2,)
    with pytest.raises(ValueError):
        SqlStore(lambda: sqlite3.connect(url), "x; drop table y")


def test_flow_into_a_database_with_its_cursor_there(spark, tmp_path):
    url = str(tmp_path / "all.db")
    rows(url, "CREATE TABLE people (id INTEGER PRIMARY KEY, name TEXT)")
    (tmp_path / "users.jsonl").write_text("\n".join(f'{{"_id": {i}, "meta": {{"seq": {100 - i}}}, "name": "u{i}"}}' for i in range(10)))
    raw = {
        "sources": [{"name": "m", "type": "mongodb", "config": {"path": str(tmp_path), "schema": {"_id": "bigint", "name": "string", "meta.seq": "bigint"}}}],
        "sinks": [{"name": "d", "type": "sqlite", "config": {"url": url}}], "storages": [{"name": "s", "type": "sqlite", "config": {"url": url}}],
        "flow": {"people": {"source": "m", "sink": "d", "storage": "s", "from": "users", "to": "people", "cursor": {"fields": ["meta.seq"]}, "batch-limit": 3, "mapping": {"id": "_id", "name": "name"}, "conflict": {"key": ["id"], "strategy": "overwrite"}}},
    }
    made = config.build(raw)
    f, (kind, options) = made.flows["people"], made.stores["s"]
    assert Runner(spark, f, open_store(spark, kind, options)).batch() [0] == 3
    assert {i for i, _ in rows(url, "SELECT id, name FROM people")} == {9, 8, 7}
    metrics = Runner(spark, f, open_store(spark, kind, options)).once()
    assert metrics.rows == 7 and rows(url, "SELECT count(*) FROM people") == [(10,)] and open_store(spark, kind, options).load("people") == (100,)


def test_cursors_of_nested_fields(spark):
    from riverbend.operators import keyset

    df = spark.range(6).select("id", F.struct(F.struct((10 - F.col("id")).alias("seq")).alias("inner")).alias("meta"))
    assert keyset.last(keyset.scan(df, ["meta.inner.seq"], (6,), True, 2), ["meta.inner.seq"]) == (8,)
    assert sorted(r["id"] for r in df.where(keyset.until(["meta.inner.seq"], (6,))).collect()) == [4, 5]
    with pytest.raises(keyset.CursorError):
        keyset.check(df, ["meta.none"])
