import datetime as dt
import decimal

from pyspark.sql import functions as F

from riverbend.operators import keyset
from riverbend.sources import Source, SourceError, jdbc_options
from riverbend.storage import CursorStore, Files


def test_cursors_keep_their_types(spark, tmp_path):
    store = CursorStore(spark, str(tmp_path / "c"))
    assert store.load("f") is None
    for cursor in ((1, None, "x"), (dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.date(2024, 1, 2)), (decimal.Decimal("12345678901234567890"), b"\x00\xff", True, 1.5)):
        store.save("f", cursor)
        assert store.load("f") == cursor
    files = Files(spark, str(tmp_path / "c"))
    assert files.names() == ["f.json"] and files.exists("f.json") and files.read("none") is None


def test_instants_as_cursors(spark):
    df = spark.range(5).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    first = keyset.scan(df, ["at", "id"], None, True, 2)
    state = keyset.last(first, ["at", "id"])
    assert [r["id"] for r in keyset.scan(df, ["at", "id"], state, True, 10).collect()] == [2, 3, 4]


def test_documents(spark, tmp_path):
    (tmp_path / "users.jsonl").write_text('{"_id": 1, "name": "a", "n": 1}\n{"_id": 2, "name": "b", "n": "x", "deep": {"k": [1]}}\n\n')
    source = Source("m", "mongodb", {"path": str(tmp_path), "schema": {"_id": "bigint", "name": "string"}})
    assert [(r["_id"], r["name"]) for r in source.read(spark, "users").orderBy("_id").collect()] == [(1, "a"), (2, "b")]
    sampled = Source("m", "mongodb", {"path": str(tmp_path)}).read(spark, "users")
    assert {"_id", "name", "n", "document"} <= set(sampled.columns)


def test_documents_unlike_the_first_thousand(spark, tmp_path):
    lines = [f'{{"_id": {i}, "n": {i}, "m": 1.5}}' for i in range(3000)] + ['{"_id": 3000, "n": "x", "late": true}', '{"_id": 3001, "m": 12345678901.123456}', '{"_id": 3002, "m": 1e300}']
    (tmp_path / "mixed.jsonl").write_text("\n".join(lines))
    (tmp_path / "wide.jsonl").write_text("\n".join(lines[:3000] + lines[3001:3002]))
    rows = Source("m", "mongodb", {"path": str(tmp_path)}).read(spark, "mixed")
    got = {r["_id"]: r for r in rows.where("cast(_id as bigint) >= 3000").select(F.col("_id").cast("bigint").alias("_id"), *[F.to_json(c).alias(c) for c in ("n", "m", "late")]).collect()}
    assert (got[3000]["n"], got[3000]["late"], float(got[3002]["m"])) == ('"x"', "true", 1e300) and got[3001]["m"] == "12345678901.123456"
    wide = Source("m", "mongodb", {"path": str(tmp_path)}).read(spark, "wide")
    assert dict(wide.dtypes)["_id"] == "bigint" and str(wide.where("_id = 3001").first()["m"]) == "12345678901.123456"


def test_jdbc_options():
    got = jdbc_options("postgres", {"url": "postgres://u:p@h:5432/db", "partition-column": "id", "lower-bound": 1, "upper-bound": 9, "partitions": 4}, "public.t")
    assert got["url"] == "jdbc:postgresql://h:5432/db" and got["user"] == "u" and got["password"] == "p" and got["numPartitions"] == "4" and got["dbtable"] == "public.t"
    try:
        Source("x", "nope").read(None, "t")
    except SourceError:
        pass
    else:
        raise AssertionError
