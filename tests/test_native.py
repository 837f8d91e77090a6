import pytest

from riverbend import types as L
from riverbend.sources.native import NativeTypeError, logical

GOOD = [
    ("postgres", "Character Varying(8)", L.Type("Text", size=8)), ("postgres", "numeric(20,0)", L.Type("BigInt", size=20)), ("postgres", "numeric(10,4)", L.decimal(10, 4)), ("postgres", "numeric", L.DECIMAL), ("postgres", "int4[]", L.array_of(L.INT32)),
    ("cockroachdb", "timestamp with time zone", L.TIMESTAMP), ("postgres", "inet", L.Type("Text", size=43)), ("mysql", "tinyint(1) unsigned", L.BOOL), ("mysql", "bigint(20) unsigned", L.UINT64), ("mysql", "mediumint", L.INT32),
    ("mysql", "varchar(36)", L.Type("Text", size=36)), ("mariadb", "decimal(12,2)", L.decimal(12, 2)), ("mysql", "decimal", L.Type("BigInt", size=10)), ("mysql", "text", L.Type("Text", size=65535)), ("questdb", "DOUBLE[]", L.array_of(L.FLOAT64, False)),
    ("questdb", "SYMBOL capacity 256", L.TEXT), ("questdb", "GEOHASH(8c)", L.TEXT), ("mongodb", "objectId", L.Type("Bytes", size=12)),
]
COLUMN_STORE = [
    ("Nullable(Int32)", L.INT32, True), ("LowCardinality(Nullable(String))", L.TEXT, True), ("Decimal(18, 4)", L.decimal(18, 4), False), ("Decimal64(3)", L.decimal(18, 3), False), ("Array(Nullable(UInt8))", L.array_of(L.UINT8, True), False),
    ("Array(Array(Int8))", L.JSON, False), ("Map(String, Array(UInt64))", L.JSON, False), ("Tuple(a String, b Nullable(Int8))", L.JSON, False), ("Enum8('a' = 1, 'b,)' = 2)", L.TEXT, False), ("DateTime('UTC')", L.TIMESTAMP, False),
    ("FixedString(16)", L.Type("Bytes", size=16), False), ("AggregateFunction(uniq, UInt64)", L.BYTES, False), ("Int256", L.TEXT, False),
]
BAD = [("postgres", "timestamp"), ("postgres", "cidr"), ("postgres", "jsonb[]"), ("postgres", "money"), ("mysql", "datetime"), ("clickhouse", "DateTime64(3)"), ("clickhouse", "Point"), ("clickhouse", "Array(Int8"), ("clickhouse", "Nope"), ("questdb", "INT[]"), ("questdb", "GEOHASH(99c)"), ("oracle", "x")]


@pytest.mark.parametrize(("system", "text", "want"), GOOD)
def test_native_types(system, text, want):
    assert logical(system, text)[0] == want


@pytest.mark.parametrize(("text", "want", "nullable"), COLUMN_STORE)
def test_column_store_types(text, want, nullable):
    assert logical("clickhouse", text) == (want, nullable)


@pytest.mark.parametrize(("system", "text"), BAD)
def test_refused_types(system, text):
    with pytest.raises(NativeTypeError):
        logical(system, text)
