import dataclasses
import datetime as dt
import json
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from riverbend import monitoring
from riverbend.operators import changes, keyset, lookup
from riverbend.operators import mapping as M
from riverbend.plans import config, validate
from riverbend.plans.flow import Metrics, QueryTimeout, Runner, limited
from riverbend.sinks import Conflict, MergeTable, SinkError, command_rows, merged, statements

READINGS = """
[[sources]]
name = "meters"
type = "parquet"
config = { path = "${ROOT}/raw" }

[[sinks]]
name = "lake"
type = "parquet"
config = { path = "${ROOT}/lake", columns = { daily = "meter string not null, at timestamp not null, litres decimal(9,1), place string, band string" } }

[[storages]]
name = "marks"
type = "files"
config = { path = "${ROOT}/marks" }

[flow.water]
from = "readings"
to = "daily"
source = "meters"
sink = "lake"
storage = "marks"
batch-limit = 2
query-timeout = "2m"
cursor = { fields = ["taken", "serial"], interval = "5s" }
conflict = { key = ["meter", "at"], strategy = "overwrite" }

[flow.water.mapping]
at = "taken"
meter = { compute = "upper(`serial`)" }
litres = { from = "m3", truncate = true }
place = { from = "site", switch = { "N" = "north", "S" = "south" }, default = "unknown" }

[flow.water.compute-mapping]
band = "multiIf(`m3` < 1, 'low', `m3` < 10, 'usual', 'high')"
"""
RAW = "serial string, taken timestamp, m3 double, site string"


def reading(i):
    return (f"w{i % 3}", dt.datetime(2031, 5, 1, i, tzinfo=dt.timezone.utc), 0.25 + i * 1.875, "NSX"[i % 3])


@pytest.fixture
def flow(spark, tmp_path):
    spark.createDataFrame([reading(i) for i in range(9)], RAW).write.parquet(str(tmp_path / "raw/readings.parquet"))
    (tmp_path / "water.toml").write_text(READINGS)
    return config.load(str(tmp_path / "water.toml"), {"ROOT": str(tmp_path)}).flows["water"], tmp_path


def lake(spark, f, root):
    return MergeTable(spark, str(root / "lake/daily"), f.sink.schema(spark, "daily"), f.conflict)


def test_flow_drains_in_growing_batches_and_goes_on_from_its_cursor(spark, flow):
    f, root = flow
    assert validate.validate(spark, f) == []
    metrics = Runner(spark, f, str(root / "marks")).once()
    assert (metrics.rows, metrics.batches, metrics.upserts) == (9, 2, 9)  # 2 rows, then up to 16
    got = {(r["meter"], r["at"].hour): r for r in lake(spark, f, root).read().collect()}
    assert set(got) == {(f"W{i % 3}", i) for i in range(9)}
    assert [(str(got[f"W{i % 3}", i]["litres"]), got[f"W{i % 3}", i]["place"], got[f"W{i % 3}", i]["band"]) for i in (0, 1, 5, 6)] == [("0.2", "north", "low"), ("2.1", "south", "usual"), ("9.6", "unknown", "usual"), ("11.5", "north", "high")]
    assert Runner(spark, f, str(root / "marks")).once().rows == 0
    spark.createDataFrame([reading(9)], RAW).write.mode("append").parquet(str(root / "raw/readings.parquet"))
    assert Runner(spark, f, str(root / "marks")).once().rows == 1


def test_a_source_that_changes_between_reading_and_writing_loses_nothing(spark, flow):
    """Rows that come while a batch is written, before and after its end, are written with it or with the next one."""
    f, root = flow
    runner = Runner(spark, f, str(root / "marks"))
    early, late = ("w9", dt.datetime(2031, 5, 1, 0, 30, tzinfo=dt.timezone.utc), 5.0, "N"), ("w8", dt.datetime(2031, 5, 1, 2, 30, tzinfo=dt.timezone.utc), 6.0, "S")
    real, calls = runner.metrics.timed, []

    def timed(stage, work):
        if stage == "transform" and not calls:  # the batch's end is known, its rows are not read
            calls.append(stage)
            spark.createDataFrame([early, late], RAW).write.mode("append").parquet(str(root / "raw/readings.parquet"))
            spark.catalog.refreshByPath(str(root / "raw/readings.parquet"))
        return real(stage, work)

    runner.metrics.timed = timed
    runner.batch(source=f.source.read(spark, f.table))
    Runner(spark, f, str(root / "marks")).once()
    meters = {(r["meter"], r["at"].hour, r["at"].minute) for r in lake(spark, f, root).read().collect()}
    assert {(f"W{i % 3}", i, 0) for i in range(9)} <= meters and ("W8", 2, 30) in meters


def test_a_failed_write_is_done_again(spark, flow, monkeypatch):
    f, root = flow
    runner = Runner(spark, f, str(root / "marks"))
    real, calls = MergeTable.write, []

    def write(self, batch, batch_id=None):
        out = real(self, batch, batch_id)
        calls.append(1)
        if len(calls) == 1:
            raise OSError("the connection is gone")
        return out

    monkeypatch.setattr(MergeTable, "write", write)
    with pytest.raises(OSError):
        runner.once()
    assert runner.metrics.errors == {"write": 1} and runner.once().rows == 9
    assert lake(spark, f, root).read().count() == 9


def test_a_sampled_tick_finds_rows_that_do_not_convert(spark, flow):
    f, root = flow
    assert validate.tick(spark, f, 4) == 4 and not (root / "lake").exists()
    spark.createDataFrame([("w1", dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc), float("nan"), "N")], RAW).write.mode("append").parquet(str(root / "raw/readings.parquet"))
    on = dataclasses.replace(f, validation={"sampling": {"enabled": True, "size": 3}})
    assert validate.validate(spark, f) == [] and [x.split(":")[0] for x in validate.validate(spark, on)] == ["water"]


def test_dry_run_writes_nothing(spark, flow):
    f, root = flow
    Runner(spark, f, str(root / "marks")).once(dry_run=True)
    assert not (root / "lake").exists() and not (root / "marks").exists()


def test_forever_backs_off_and_keeps_the_grid(spark, flow):
    f, root = flow
    waits: list[float] = []
    runner = Runner(spark, f, str(root / "marks"))
    calls = iter([(2, None), RuntimeError(), RuntimeError(), (1, None)])

    def batch():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    runner.batch = batch
    runner.forever(stop=lambda: len(waits) == 3, sleep=waits.append, clock=lambda: 11.25)
    assert waits == [1, 4, 3.75]


def test_a_query_over_its_time_is_stopped(spark):
    slow = spark.range(1).select(F.pandas_udf(lambda s: (time.sleep(20), s)[1], "long")("id"))
    began = time.monotonic()
    with pytest.raises(QueryTimeout), limited(spark, 1.0, "slow"):
        slow.collect()
    assert time.monotonic() - began < 15
    with limited(spark, 30.0, "quick"):
        assert spark.range(3).count() == 3


def test_command_line(spark, flow, capsys, monkeypatch):
    from riverbend.__main__ import main

    f, root = flow
    monkeypatch.setenv("ROOT", str(root))
    path, counters = str(root / "water.toml"), root / "counters"
    assert main(["validate", path]) == 0
    assert main(["run", path, "--once", "--metrics", str(counters)]) == 0
    assert lake(spark, f, root).read().count() == 9
    assert 'riverbend_flow_rows_total{flow="water"} 9' in counters.read_text() and 'riverbend_flow_seconds_total{flow="water",stage="write"}' in counters.read_text()
    (root / "water.toml").write_text(READINGS.replace("`m3`", "`gallons`"))
    assert main(["validate", path]) == 1 and "gallons" in capsys.readouterr().err
    (root / "water.toml").write_text(READINGS.replace("multiIf(`m3` < 1,", "multiIf(toInt8(`m3` * 1000.0) < 1,"))
    (root / "marks").rename(root / "old-marks")
    assert main(["run", path, "--once"]) == 1 and "water:" in capsys.readouterr().err  # a flow that fails fails the command
    with pytest.raises(SystemExit):
        main(["run", path, "--flow", "nope"])


def test_counters_over_http():
    server = monitoring.serve(lambda: {'a"b': Metrics(rows=7, errors={"read": 2}, seconds={"write": 1.5})}, 0)
    try:
        text = urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/metrics").read().decode()
    finally:
        server.shutdown()
    assert 'riverbend_flow_rows_total{flow="a\\"b"} 7' in text and 'riverbend_flow_errors_total{flow="a\\"b",stage="read"} 2' in text and 'stage="write"} 1.5' in text


def test_null_is_the_smallest_in_cursor_order(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 3), (4, None)], "id int, rank int")
    order = lambda state, up=True: [r["id"] for r in keyset.scan(df, ["rank", "id"], state, up, 10).collect()]
    assert order(None) == [2, 4, 1, 3]
    assert order((None, 2)) == [4, 1, 3] and order((None, 4)) == [1, 3] and order((1, 1)) == [3]
    assert order(None, False) == [3, 1, 4, 2] and order((1, 1), False) == [4, 2]
    assert keyset.last(df, ["rank", "id"]) == (3, 3)
    with pytest.raises(keyset.CursorError):
        keyset.check(df, ["none"])


def test_cursor_predicate_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    plan = keyset.scan(spark.read.parquet(str(tmp_path / "t")), ["id"], (50,), limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(id,50)" in plan.split("PushedFilters")[1]


def test_change_events(spark):
    events = spark.createDataFrame([(1, "insert", 1, "a"), (1, "update", 2, "b"), (2, "insert", 3, "c"), (2, "delete", 4, None), (3, "other", 5, "x")], "k int, operation string, sequence int, v string")
    got = {r["k"]: (r["_op"], r["v"]) for r in changes.latest(changes.tag(events, "operation"), ["k"], "sequence").collect()}
    assert got == {1: ("U", "b"), 2: ("D", None)}
    table = spark.createDataFrame([(1, "now")], "k int, v string")
    images = changes.with_post_images(changes.latest(changes.tag(events, "operation"), ["k"], "sequence").select("k", "v", "_op"), table, ["k"])
    assert {r["k"]: (r["_op"], r["v"]) for r in images.collect()} == {1: ("U", "now"), 2: ("D", None)}
    with pytest.raises(Exception, match="destructive"):
        changes.tag(events.withColumn("operation", F.lit("drop")), "operation").collect()


def test_conflicts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    batch = spark.createDataFrame([(1, "A", "U"), (4, "D", "U"), (3, None, "D")], "k int, v string, _op string")
    rows = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert rows(merged(old, batch, Conflict(("k",)))) == {1: "A", 2: "b", 4: "D"}
    assert rows(merged(old, batch, Conflict(("k",), "ignore"))) == {1: "a", 2: "b", 4: "D"}
    for strategy, one in (("overwrite", "A"), ("ignore", "a")):
        t = MergeTable(spark, str(tmp_path / strategy), old.schema, Conflict(("k",), strategy))
        assert t.read().count() == 0
        t.write(old)
        assert t.write(batch) .deletes == 1
        assert rows(t.read()) == {1: one, 2: "b", 4: "D"}
        t.write(batch, 1)  # a replayed batch replaces itself
        assert rows(t.read()) == {1: one, 2: "b", 4: "D"}
        t.compact()
        assert rows(t.read()) == {1: one, 2: "b", 4: "D"} and len(t.batches()) == 1
        t.write(spark.createDataFrame([(3, "again", "U")], batch.schema))
        assert rows(t.read())[3] == "again"
    with pytest.raises(SinkError):
        MergeTable(spark, str(tmp_path / "x"), old.schema, Conflict(("none",)))


def test_mapping_wildcard_body_switch(spark):
    df = spark.createDataFrame([(1, "x", 7), (2, None, 8)], "a int, b string, c int")
    sink = {"a": (M.L.INT64, False), "b": (M.L.TEXT, True), "extra": (M.L.TEXT, True)}
    assert M.apply(df, M.rules({"*": "*"}), sink).columns == ["a", "b"]
    with pytest.raises(M.MappingError):
        M.apply(df, M.rules({"*": "*"}), sink | {"must": (M.L.TEXT, False)})
    out = M.apply(df, M.rules({"id": "a", "all": "*", "kind": {"from": "c", "switch": {"7": "seven"}, "default": "other"}, "b": {"from": "b", "default": "none"}}, {"d": "`a` + `c`"}))
    r = out.selectExpr("id", "to_json(all) j", "kind", "b", "d").collect()
    assert json.loads(r[0]["j"]) == {"a": 1, "b": "x", "c": 7} and [x["kind"] for x in r] == ["seven", "other"] and r[1]["b"] == "none" and r[0]["d"] == 8
    for bad in ({}, {"*": "a"}, {"*": "*", "x": "*"}, {"x": {"from": "a", "compute": "1"}}, {"x": {"from": "a", "odd": 1}}):
        with pytest.raises(M.MappingError):
            M.rules(bad)
    table = spark.createDataFrame([(7, "seven"), (7, "seven")], "k int, v string")
    assert [r["c2"] for r in lookup.lookup_table(df, "c", table, "k", "v", "?", "c2").orderBy("a").collect()] == ["seven", "?"]


def test_only_columns_in_use_are_read(spark, tmp_path):
    spark.range(3).selectExpr("id", "id x", "id y").write.parquet(str(tmp_path / "t"))
    plan = M.apply(spark.read.parquet(str(tmp_path / "t")), M.rules({"a": "x"}))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:bigint>" in plan


def test_key_value_commands(spark):
    df = spark.createDataFrame([("u1", "v", dt.timedelta(hours=1), "U"), ("u2", None, None, "D")], "key string, value string, ttl interval day to second, _op string")
    got = [r["command"] for r in command_rows(df, "kv", "users:").collect()]
    assert got == [["SET", "users:u1", '"v"', "PX", "3600000"], ["DEL", "users:u2"]]
    assert command_rows(df.select("key", "value"), "stream", "s:").first()["command"] == ["XADD", "s:u1", "*", "data", '"v"']
    assert command_rows(df.select("value"), "list", "l").first()["command"] == ["RPUSH", "l", '"v"']
    with pytest.raises(SinkError):
        command_rows(df, "list", "l")


def test_statements():
    up, down = statements("postgres", "public.t", ["id", "v"], Conflict(("id",)))
    assert up == 'INSERT INTO "public"."t" ("id", "v") VALUES (?, ?) ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"' and down == 'DELETE FROM "public"."t" WHERE "id" = ?'
    assert statements("postgres", "t", ["id"], Conflict(("id",)))[0].endswith("DO NOTHING")
    assert statements("mysql", "t", ["id", "v"], Conflict(("id",), "ignore"))[0].startswith("INSERT IGNORE INTO `t`")


def test_configuration():
    assert config.expand("a ${X:-d} $${Y}", {}, {}) == "a d ${Y}"
    assert config.constant('env("K", "z")', {"K": "v"}, ".") == "v" and config.constant("x-{env('K')}", {"K": "v"}, ".") == "x-v" and config.constant("plain", {}, ".") == "plain"
    assert config.seconds("1m30s") == 90
    with pytest.raises(config.ConfigError):
        config.expand("${NOPE}", {}, {})


def test_a_compaction_that_stops_halfway(spark, tmp_path, monkeypatch):
    t = MergeTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, v string").schema)  # no conflict rule: rows would double
    for v in "abc":
        t.write(spark.createDataFrame([(1, v)], "k int, v string"))
    monkeypatch.setattr(t.files, "delete", lambda name: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        t.compact()
    again = MergeTable(spark, t.path, t.schema)
    assert sorted(r["v"] for r in again.read().collect()) == ["a", "b", "c"] and len(again.batches()) == 1
    again.write(spark.createDataFrame([(2, "d")], "k int, v string"))
    again.compact()
    assert sorted(r["v"] for r in again.read().collect()) == ["a", "b", "c", "d"] and len([n for n in again.files.names() if n.startswith("batch=")]) == 1


def test_a_stream_starts_anew_after_errors():
    from riverbend import streaming

    class Query:
        def __init__(self, error):
            self.error = error

        def awaitTermination(self):
            if self.error:
                raise self.error

    runs, waits = iter([Query(RuntimeError("a")), Query(RuntimeError("b")), Query(None)]), []
    streaming.forever(lambda: next(runs), "f", sleep=waits.append)
    assert waits == [1, 4]


def test_streaming_flow_of_change_events(spark, tmp_path):
    from riverbend import streaming

    root = tmp_path
    src = root / "ev"
    schema = "_id bigint, name string, operation string, sequence bigint"
    spark.createDataFrame([(1, "a", "insert", 1), (2, "b", "insert", 2), (1, "c", "update", 3)], schema).write.parquet(str(src / "users.parquet"))
    raw = {
        "sources": [{"name": "s", "type": "cdc", "config": {"path": str(src)}}], "sinks": [{"name": "o", "type": "parquet", "config": {"path": str(root / "cdc")}}],
        "storages": [{"name": "st", "type": "parquet", "config": {"path": str(root / "st")}}],
        "flow": {"users": {"source": "s", "sink": "o", "storage": "st", "from": "users", "to": "users", "mapping": {"id": "_id", "name": "name"}, "conflict": {"key": ["id"], "strategy": "overwrite"}}},
    }
    f = config.build(raw).flows["users"]
    for more in ([], [(2, None, "delete", 4)]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(str(src / "users.parquet"))
        q = streaming.start(spark, f, str(root / "st"), once=True)
        q.awaitTermination()
    table = MergeTable(spark, str(root / "cdc/users"), spark.createDataFrame([], "id bigint, name string").schema, f.conflict)
    assert {r["id"]: r["name"] for r in table.read().collect()} == {1: "c"}


def test_lookups_on_update_take_the_configured_table(spark, tmp_path):
    from riverbend import streaming

    schema = "_id bigint, name string, operation string, sequence bigint"
    spark.createDataFrame([(1, "old", "insert", 1), (2, "b", "insert", 2), (3, None, "delete", 3)], schema).write.parquet(str(tmp_path / "ev/users.parquet"))
    spark.createDataFrame([(1, "now")], "_id bigint, name string").write.parquet(str(tmp_path / "present/users.parquet"))
    raw = {
        "sources": [{"name": "s", "type": "cdc", "config": {"path": str(tmp_path / "ev"), "present": str(tmp_path / "present")}}], "sinks": [{"name": "o", "type": "parquet", "config": {"path": str(tmp_path / "out")}}],
        "storages": [{"name": "st", "type": "parquet", "config": {"path": str(tmp_path / "st")}}],
        "flow": {"users": {"source": {"name": "s", "mode": "lookup-on-update"}, "sink": "o", "storage": "st", "from": "users", "to": "users", "mapping": {"id": "_id", "name": "name"}, "conflict": {"key": ["id"], "strategy": "overwrite"}}},
    }
    f = config.build(raw).flows["users"]
    progress = monitoring.Progress()
    spark.streams.addListener(progress)
    try:
        streaming.start(spark, f, str(tmp_path / "st"), once=True).awaitTermination()
        for _ in range(50):
            if progress.metrics:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    table = MergeTable(spark, str(tmp_path / "out/users"), spark.createDataFrame([], "id bigint, name string").schema, f.conflict)
    assert {r["id"]: r["name"] for r in table.read().collect()} == {1: "now"}
    assert progress.metrics["users"].rows == 3 and progress.metrics["users"].seconds


def log_client(options):
    """A change log in a file, one event a line, for test_a_change_stream_goes_on_from_its_token."""

    class Client:
        def read(self, collection, token, limit, full):
            with open(f"{options['database']}/{collection}.log") as f:
                events = [json.loads(line) for line in f]
            return [e for e in events if token is None or e["token"] > token][:limit]

    return Client()


def test_a_change_stream_goes_on_from_its_token(spark, tmp_path):
    from riverbend import streaming

    def log(*events):
        with (tmp_path / "users.log").open("a") as f:
            f.writelines(json.dumps({"token": t, "operationType": op, "documentKey": {"_id": i}, "fullDocument": name and {"_id": i, "deep": {"name": name}}}) + "\n" for t, op, i, name in events)

    raw = {
        "sources": [{"name": "s", "type": "mongo-cdc", "config": {"client": "test_flow:log_client", "database": str(tmp_path), "limit": 2, "schema": {"_id": "bigint", "deep.name": "string"}}}],
        "sinks": [{"name": "o", "type": "parquet", "config": {"path": str(tmp_path / "out")}}], "storages": [{"name": "st", "type": "files", "config": {"path": str(tmp_path / "st")}}],
        "flow": {"users": {"source": "s", "sink": "o", "storage": "st", "from": "users", "to": "users", "mapping": {"id": "_id", "name": "deep.name"}, "conflict": {"key": ["id"], "strategy": "overwrite"}}},
    }
    f = config.build(raw).flows["users"]
    table = MergeTable(spark, str(tmp_path / "out/users"), spark.createDataFrame([], "id bigint, name string").schema, f.conflict)

    def run(want):
        streaming.drain(spark, f, str(tmp_path / "st"))
        assert {r["id"]: r["name"] for r in table.read().collect()} == want

    log((1, "insert", 1, "a"), (2, "insert", 2, "b"), (3, "update", 1, "A"))
    run({1: "A", 2: "b"})
    log((4, "delete", 2, None), (5, "replace", 3, "c"))
    run({1: "A", 3: "c"})
    assert len(table.batches()) == 3  # of two events, one and two; none twice
