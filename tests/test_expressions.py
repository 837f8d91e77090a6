import datetime as dt
import decimal
import math
import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.convert import ConversionError, coerce, convert
from riverbend.expr import syntax
from riverbend.expr.compiler import columns_read, compile_expression, compile_template
from riverbend.expr.tree import ExprError
from riverbend.expr.values import REGISTRY, Context, Value, literal
from riverbend.functions.digests import city64, fnv1a64, siphash24

NOW = dt.datetime(2024, 2, 29, 12, 0, tzinfo=dt.timezone.utc)
D = decimal.Decimal

# expression, value, type; every value is what the language defines.
CASES = [
    ("7 / 2", 3, "Int64"), ("-7 / 2", -3, "Int64"), ("-7 % 3", -1, "Int64"), ("9223372036854775807 + 1", D(2**63), "BigInt"), ("-9223372036854775807 - 2", D(-(2**63) - 1), "BigInt"), ("1.5 + 2", 3.5, "Float64"),
    ("2 ** 3 ** 2", 512.0, "Float64"), ("1 + 2 * 3", 7, "Int64"), ("(1 + 2) * 3", 9, "Int64"), ("round(-2.5)", -3, "Int64"), ("round(2.5)", 3, "Int64"), ("min(3, null, 1)", 1, "Int64"), ("max(null, null)", None, "Null"), ("min(5)", 5, "Int64"),
    ("null == null", True, "Bool"), ("null == 1", False, "Bool"), ("null != 1", True, "Bool"), ("null >= null", False, "Bool"), ("1 == 1.0", True, "Bool"), ("log(-1) == log(-1)", False, "Bool"), ("log(-1) > 1", False, "Bool"),
    ("!(null == 1) && true", True, "Bool"), ("true || (1 / 0 == 1)", True, "Bool"), ("if(null, 1, 2)", 2, "Int64"), ("if (false) { x = 1; x } else { y = 2; y + 1 }", 3, "Int64"), ("nullIf(2, 2)", None, "Int64"), ("ifNull(null, 'a')", "a", "Text"),
    ("'a' + 'b'", "ab", "Text"), ("[1, 2] + [3]", [1, 2, 3], "Array(Int64)"), ("toString(1.0)", "1", "Text"), ("toString(1.5 * 1000000000000000000000.0)", "1500000000000000000000", "Text"), ("toString(0.000001)", "0.000001", "Text"), ("toString(log(0))", "-inf", "Text"),
    ("toString(log(-1))", "NaN", "Text"), ("toString(-0.5)", "-0.5", "Text"), ("toString(true)", "true", "Text"), ("toString(bytesFromHex('0aFF'))", "0aff", "Text"), ("toString([1, null])", "[1,null]", "Text"), ("\"a{1 + 1}{null}{{}\"", "a2{}", "Text"),
    ("replace('abc', '', '-')", "-a-b-c-", "Text"), ("trim('  x ')", "x", "Text"), ("leftPad('ab', 5, 'xy')", "xxxab", "Text"), ("rightPad('abc', 2)", "abc", "Text"), ("charAt('hé', 1)", "é", "Text"), ("charAt('a', 5)", None, "Text"), ("'abcdef'[1:-1]", "bcde", "Text"),
    ("'abc'[-10:2]", "ab", "Text"), ("[1, 2, 3][-1]", 3, "Int64"), ("[1, 2, 3][1:]", [2, 3], "Array(Int64)"), ("split('a.b..c', '.')", ["a", "b", "", "c"], "Array(Text)"), ("split('ab', '')", ["a", "b"], "Array(Text)"), ("join([1, null, 3], '-')", "1--3", "Text"),
    ("3 in [1, 2]", False, "Bool"), ("'b' in 'abc'", True, "Bool"), ("indexOf('abc', 'c')", 2, "Int64"), ("indexOf([1, 2], 9)", -1, "Int64"), ("arrayGet([1], 5, 9)", 9, "Int64"), ("len('\U0001f600a')", 2, "Int64"), ("isEmpty('')", True, "Bool"),
    ("objectKeys({\"z\" = 1, \"a\" = 2}, 0)", "z", "Text"), ("objectKeys({\"z\" = 1}, 4)", None, "Text"), ("objectGet({\"a\" = 1}, 'b')", None, "Null"), ("{\"a\" = 'x'}[\"a\"]", "x", "Text"), ("objectHasKey({\"a\" = 1}, 'a')", True, "Bool"),
    ("jsPathInt(parseJson('{\"a\": \"5\"}'), '$.a')", None, "Int64"), ("jsPathString(parseJson('{\"a\": \"5\"}'), '$.a')", "5", "Text"), ("jsPathInt(parseJson('{\"a\": [1, {\"b\": 7}]}'), '$..b')", 7, "Int64"), ("jsPathFloat(parseJson('[1.5]'), '$[0]')", 1.5, "Float64"),
    ("jsPathInt(parseJson('[{\"k\": 1, \"v\": 10}, {\"k\": 2, \"v\": 20}]'), '$[?(@.k == 2)].v')", 20, "Int64"), ("regexReplace('ab1', '(?P<x>[a-z]+)(\\d)', '$2${x}$$')", "1ab$", "Text"), ("regexMatch('xabc', 'b.')", True, "Bool"),
    ("toString(addMonths(toTimestamp('2024-01-31T10:00:00Z'), 1))", "2024-02-29T10:00:00+00:00", "Text"), ("toString(toTimestamp('2024-01-31T10:00:00.000500+01:00'))", "2024-01-31T09:00:00.000500+00:00", "Text"), ("toString(now())", "2024-02-29T12:00:00+00:00", "Text"),
    ("dateDiff('hour', toTimestamp('2024-01-01T00:00:00Z'), toTimestamp('2023-12-31T22:30:00Z'))", -1, "Int64"), ("dayOfWeek(toDate('2024-01-07'))", 7, "Int64"), ("formatDateTime(toTimestamp('2024-01-05T13:04:05Z'), '%e|%-d|%I%p|%U|%V|%s|%.3f')", " 5|5|01PM|00|01|1704459845|.000", "Text"),
    ("log(0)", -math.inf, "Float64"), ("gamma(5)", 24.0, "Float64"), ("clamp(5, 1, 3)", 3.0, "Float64"), ("isInfinite(1.0)", False, "Bool"), ("1 << 3 | 1", 9, "Int64"), ("~5", -6, "Int64"), ("bitCount(-1)", 64, "Int64"), ("0xFF & 0x0F", 15, "Int64"),
    ("hex(bytesFromUtf8('hé'))", "68c3a9", "Text"), ("base64Url(bytesFromHex('fbff'))", "-_8", "Text"), ("byteAt(bytesFromHex('0aff'), 1)", 255, "Int64"), ("byteAt(bytesFromHex('0aff'), 2)", None, "Int64"), ("urlEncode('a b~*/é')", "a%20b~%2A%2F%C3%A9", "Text"), ("urlDecode('a%20b+c')", "a b+c", "Text"),
    ("decodeText(encodeText('é', 'latin1'), 'latin1')", "é", "Text"), ("xxHash64('')", -1205034819632174695, "Int64"), ("xxHash64('abc')", 4952883123889572249, "Int64"), ("sipHash64('')", 0x1E924B9D737700D7, "Int64"), ("fnv1a64('')", 0xCBF29CE484222325 - 2**64, "Int64"),
    ("hmac('sha256', 'msg', 'key')", "2d93cbc1be167bcb1637a4a23cbff01a7878f0c50ee833954ea5221bb1b8c628", "Text"), ("toInt64(1.9)", 1, "Int64"), ("toInt64(' 12 ')", 12, "Int64"), ("toUInt8('255')", 255, "UInt8"),
    ("toBool('maybe')", True, "Bool"), ("toBool('')", False, "Bool"), ("toDecimal('1.239', 10, 2)", D("1.23"), "Decimal(10,2)"), ("toDecimal(-1.999, 5, 1)", D("-1.9"), "Decimal(5,1)"), ("toUuid('{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}')", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "Uuid"),
    ("typeof(1.5)", "Float64", "Text"), ("env('NONE', 'd')", "d", "Text"), ("env('HERE')", "v", "Text"), ("seconds(objectId('507f1f77bcf86cd799439011'))", 1350508407, "Int64"), ("toString(1h30m)", "5400s", "Text"), ("PT1M", dt.timedelta(minutes=1), "Interval"), ("500ms", dt.timedelta(milliseconds=500), "Interval"),
    ("randomInt(1, 9, 3) == randomInt(1, 9, 3)", True, "Bool"), ("len(randomHex(33))", 33, "Int64"), ("a = 1; b = a + 1\nb * 10 # a comment", 20, "Int64"), ("-abs(-3)", -3, "Int64"), ("sign(-2.5)", -1, "Int64"),
]
FAILING = ["1 / 0", "1.0 / 0.0", "5 % 0", "[1][3]", "toInt8(200)", "toUInt8(-1)", "toDate('2024-1-1')", "bytesFromHex('abc')", "1 << 64", "clamp(1, 3, 2)", "repeat('a', 2000000)", "toInt64(log(-1))", "toTimestamp('2024-01-01')", "parseJson('{')"]
REJECTED = ["1 +", "'x", "a b", "1 < 2 < 3", "foo(1)", "len()", "'a' + 1", "field('nope')", "regexMatch('a', '(?=b)')", "regexMatch('a', '(a)\\1')", "dateDiff('week', now(), now())", "formatDateTime(now(), '%Q')", "toDecimal(1, 2, 3)", "not(1)", "unknown_name", "{\"a\" = 1}[\"b\"]", "(" * 200 + "1" + ")" * 200]


def context(**fields):
    return Context(fields, NOW, {"HERE": "v"})


def test_values(spark):
    made = [compile_expression(text, context()) for text, _, _ in CASES]
    row = spark.range(1).select(*[v.col.alias(f"c{i}") for i, v in enumerate(made)]).first()
    wrong = []
    for i, ((text, want, kind), v) in enumerate(zip(CASES, made, strict=True)):
        got = row[i]
        same = got == want or (isinstance(want, float) and got is not None and math.isclose(got, want, rel_tol=1e-12))
        if not same or str(v.type) != kind:
            wrong.append((text, got, want, str(v.type), kind))
    assert wrong == []


@pytest.mark.parametrize("text", FAILING)
def test_failing_values_raise(spark, text):
    with pytest.raises(Exception):
        spark.range(1).select(compile_expression(text, context()).col).collect()


@pytest.mark.parametrize("text", REJECTED)
def test_rejected_when_compiling(text, spark):
    with pytest.raises(ExprError):
        compile_expression(text, context())


def test_only_the_branch_taken_may_fail(spark):
    x = compile_expression("if(`id` == 0, 0, 10 / `id`)", context(id=L.INT64)).col
    assert [r[0] for r in spark.range(3).select(x).collect()] == [0, 10, 5]


def test_every_function_is_registered():
    assert len(REGISTRY) == 185  # env with one and with two arguments is one entry


def test_fields_and_templates(spark):
    ctx = context(id=L.INT64)
    assert columns_read("`id` + 1", ctx) == {"id"} and columns_read("fields(\"*\")", ctx) == {"id"}
    assert spark.range(1).select(compile_template("a {`id`} }}", ctx).col).first()[0] == "a 0 }"
    assert syntax.looks_like_expression("env(\"K\")") and not syntax.looks_like_expression("hello world") and syntax.has_interpolation("a{b}") and not syntax.has_interpolation("a{{b")


def test_hashes():
    key = int.from_bytes(bytes(range(8)), "little"), int.from_bytes(bytes(range(8, 16)), "little")
    texts = [bytes(i % 256 for i in range(n)) for n in (15, 0, 7, 8, 9, 63, 64, 300)]
    assert siphash24(texts, *key)[0] == 0xA129CA6149BE45E5  # the paper's vector
    assert siphash24(texts, *key).tolist() == [int(siphash24([t], *key)[0]) for t in texts] and siphash24([]).size == fnv1a64([]).size == 0

    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    assert fnv1a64(texts).tolist() == [plain(t) for t in texts] and fnv1a64([b"a"])[0] == 0xAF63DC4C8601EC8C and city64(b"") == 0x9AE16A3B2F90404F
    assert len({city64(b"x" * n) for n in range(200)}) == 200


def test_lattice():
    yes = [(L.INT8, L.INT64), (L.INT32, L.FLOAT64), (L.UINT32, L.INT64), (L.FLOAT32, L.FLOAT64), (L.INT64, L.decimal(19, 0)), (L.TEXT, L.XML), (L.Type("Text", size=3), L.Type("Text", size=5)), (L.UUID, L.Type("Text", size=36)), (L.BOOL, L.INT8), (L.DATE, L.TEXT), (L.IPV4, L.IPV6)]
    no = [(L.INT64, L.INT32), (L.INT64, L.FLOAT64), (L.UINT64, L.INT64), (L.decimal(10, 2), L.FLOAT64), (L.INT64, L.decimal(18, 0)), (L.TEXT, L.Type("Text", size=5)), (L.DATE, L.TIMESTAMP), (L.TIMESTAMP, L.DATE), (L.UUID, L.Type("Text", size=10))]
    assert all(L.lossless(a, b) for a, b in yes) and not any(L.lossless(a, b) for a, b in no)
    assert L.convertible(L.INT64, L.INT32) and L.convertible(L.TIMESTAMP, L.DATE) and not L.convertible(L.DATE, L.TIMESTAMP) and L.convertible(L.IPV6, L.IPV4)
    assert L.union(L.INT32, L.INT8) == L.INT64 and L.union(L.INT64, L.FLOAT64) == L.FLOAT64 and L.union(L.TEXT, L.INT64) == L.JSON


def test_conversions(spark):
    lossy = lambda text, t: convert(compile_expression(text, context()), t, True).col
    cases = [
        (lossy("300", L.INT8), 127), (lossy("-300", L.UINT8), 0), (lossy("-1.9", L.INT32), -1), (lossy("'abcdef'", L.Type("Text", size=3)), "abc"), (lossy("0", L.BOOL), False), (lossy("'YES'", L.BOOL), True), (lossy("toDecimal('12.345', 10, 3)", L.decimal(5, 1)), D("12.3")),
        (lossy("toTimestamp('2024-01-02T03:04:05Z')", L.DATE), dt.date(2024, 1, 2)), (lossy("1.5", L.TEXT), "1.5"), (lossy("toUuid('a0eebc999c0b4ef8bb6d6bb9bd380a11')", L.Type("Bytes", size=16)), bytes.fromhex("a0eebc999c0b4ef8bb6d6bb9bd380a11")),
        (convert(literal("10.0.0.1"), L.IPV4).col, "10.0.0.1"), (convert(Value(F.lit("10.0.0.1"), L.IPV4), L.IPV6).col, "::ffff:10.0.0.1"), (convert(Value(F.lit("10.0.0.1"), L.IPV4), L.Type("Bytes", size=4)).col, bytes([10, 0, 0, 1])), (convert(literal("<a/>"), L.XML).col, "<a/>"),
        (convert(literal(None), L.INT32, default=5).col, 5), (convert(Value(F.lit(None).cast("binary"), L.BYTES), L.BYTES, default="hex:00ff").col, b"\x00\xff"), (coerce(compile_expression("3 + 4", context()), L.INT8).col, 7),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [(g, w) for g, (_, w) in zip(got, cases, strict=True) if g != w] == []
    with pytest.raises(ConversionError):
        convert(literal(1), L.INT8)
    for bad in (coerce(literal(300), L.INT8).col, convert(literal("<a>"), L.XML).col, convert(literal("perhaps"), L.BOOL).col):
        with pytest.raises(Exception):
            spark.range(1).select(bad).collect()


_OPS = {"+": operator.add, "-": operator.sub, "*": operator.mul}


@st.composite
def programs(draw, depth=0):
    if depth == 4 or draw(st.booleans()):
        n = draw(st.integers(-50, 50))
        return (f"({n})", n)
    op = draw(st.sampled_from([*_OPS, "if", "min", "/", "%"]))
    (a, x), (b, y) = draw(programs(depth + 1)), draw(programs(depth + 1))
    if op == "if":
        return (f"if({a} < {b}, {a}, {b})", x if x < y else y)
    if op == "min":
        return (f"min({a}, {b}, null)", min(x, y))
    if op in ("/", "%"):
        if y == 0:
            return (a, x)
        q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        return (f"({a} {op} {b})", q if op == "/" else x - q * y)
    return (f"({a} {op} {b})", _OPS[op](x, y))


@settings(max_examples=4, deadline=None)
@given(st.lists(programs(), min_size=30, max_size=30))
def test_random_programs_agree_with_plain_python(spark, cases):
    row = spark.range(1).select(*[compile_expression(t, context()).col.alias(f"c{i}") for i, (t, _) in enumerate(cases)]).first()
    assert [int(v) for v in row] == [w for _, w in cases]
