"""The registered queries of flows and expressions, each with the DuckDB SQL that must give the same rows.

Expression queries list, for a table, its key columns and (name, expression, SQL) of every computed column.
"""

from __future__ import annotations

import atexit
import copy
import datetime as dt
import math
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbend import streaming
from riverbend import types as L
from riverbend.convert import convert
from riverbend.expr import syntax
from riverbend.expr.compiler import Compiler
from riverbend.expr.syntax import parse
from riverbend.expr.values import Context
from riverbend.operators import changes, keyset, lookup, mapping
from riverbend.plans import config
from riverbend.plans.flow import Runner, bulk
from riverbend.sinks import Conflict, MergeTable, Sink, command_rows, merged
from riverbend.sinks.writers import nullable_value
from riverbend.sources import Source, embedded, normalised

CLOCK = dt.datetime(2024, 2, 29, 12, 30, 15, 250_000, tzinfo=dt.timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normalised(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: The error function's series, for arguments under 1.
_ERF = "2 / sqrt(pi()) * (" + " + ".join(f"{(-1) ** n / (math.factorial(n) * (2 * n + 1))!r}::double * pow(l_tax, {2 * n + 1})" for n in range(12)) + ")"
#: FNV-1a of 64 bits over the bytes of a short ASCII text, as the signed number of its bits; the offset and the prime are fixed values.
_FNV = ("(SELECT CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::bigint FROM (SELECT list_reduce(list_prepend(14695981039346656037::uhugeint, "
        "list_transform(string_split(source, ''), lambda c: ascii(c)::uhugeint)), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::hugeint AS h))")

# table, key columns, [(name, expression, SQL)]; a SQL of None leaves the whole query without an oracle.
EXPRESSIONS: dict[str, tuple[str, str, list[tuple[str, str, str | None]]]] = {
    "expr_arithmetic": ("lineitem", "l_orderkey, l_linenumber", [
        ("total", "`l_extendedprice` * (1 - `l_discount`) * (1 + `l_tax`)", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"),
        ("half", "`l_orderkey` / 2", "l_orderkey // 2"), ("negative_half", "-`l_orderkey` / 2", "-(l_orderkey // 2)"),
        ("rest", "-`l_orderkey` % 7", "(-l_orderkey) % 7"), ("wide", "toString(`l_orderkey` * `l_partkey` + 1)", "(l_orderkey * l_partkey + 1)::varchar"),
        ("less", "`l_linenumber` - 10", "(l_linenumber - 10)::bigint"), ("square", "`l_quantity` ** 2", "pow(l_quantity, 2)"), ("root", "sqrt(`l_quantity`)", "sqrt(l_quantity)"),
        ("up", "ceil(`l_tax` * 10)", "ceil(l_tax * 10)::bigint"), ("down", "floor(-`l_tax` * 10)", "floor(-l_tax * 10)::bigint"), ("near", "round(`l_quantity` / 2.0)", "round(l_quantity / 2.0)::bigint"),
        ("absolute", "abs(`l_linenumber` - 3)", "abs(l_linenumber - 3)::bigint"), ("direction", "sign(`l_linenumber` - 3)", "sign(l_linenumber - 3)::bigint"),
        ("least_of", "min(`l_linenumber`, 3, null)", "least(l_linenumber, 3)::bigint"), ("most_of", "max(`l_linenumber`, 3)", "greatest(l_linenumber, 3)::bigint"),
        ("negated", "-`l_linenumber`", "(-l_linenumber)::bigint"), ("joined", "`l_returnflag` + '-' + `l_linestatus`", "l_returnflag || '-' || l_linestatus"),
    ]),
    "expr_comparison": ("orders", "o_orderkey", [
        ("same", "`o_orderstatus` == 'F'", "o_orderstatus = 'F'"), ("other", "`o_orderstatus` != 'F'", "o_orderstatus <> 'F'"),
        ("null_same", "nullIf(`o_orderstatus`, 'F') == null", "o_orderstatus = 'F'"), ("null_greater", "nullIf(`o_custkey`, 1) > 5", "coalesce(nullif(o_custkey, 1) > 5, false)"),
        ("null_at_least", "nullIf(`o_orderstatus`, 'F') >= null", "false"), ("less", "`o_totalprice` < 100000", "o_totalprice < 100000"), ("at_most", "`o_custkey` <= 50", "o_custkey <= 50"),
        ("greater", "`o_totalprice` > 100000.5", "o_totalprice > 100000.5"), ("at_least", "`o_orderpriority` >= '3'", "o_orderpriority >= '3'"),
        ("absent", "isNull(nullIf(`o_orderstatus`, 'O'))", "o_orderstatus = 'O'"), ("present", "isNotNull(nullIf(`o_orderstatus`, 'O'))", "o_orderstatus <> 'O'"),
        ("not_number", "log(-1) == log(-1)", "false"), ("negation", "!(`o_orderstatus` == 'F')", "not (o_orderstatus = 'F')"),
    ]),
    "expr_conditional": ("orders", "o_orderkey", [
        ("label", "if(`o_orderstatus` == 'F', 'closed', 'open')", "if(o_orderstatus = 'F', 'closed', 'open')"),
        ("size", "if (`o_totalprice` > 200000) 'big' else if (`o_totalprice` > 100000) { half = `o_totalprice` / 2; \"mid {floor(half)}\" } else 'small'", "case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid ' || floor(o_totalprice / 2)::bigint else 'small' end"),
        ("kind", "multiIf(`o_custkey` % 3 == 0, 'a', `o_custkey` % 3 == 1, 'b', 'c')", "case o_custkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end"),
        ("looked_up", "multiIf(" + ", ".join(f"`o_orderpriority` == '{p}', {i}" for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6", "7", "8", "9"))) + ", -1)",
         "case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 when '5-LOW' then 4 else -1 end::bigint"),
        ("filled", "coalesce(nullIf(`o_orderstatus`, 'F'), nullIf(`o_orderstatus`, 'O'), '?')", "coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderstatus, 'O'), '?')"),
        ("or_else", "ifNull(nullIf(`o_custkey`, 1), -1)", "coalesce(nullif(o_custkey, 1), -1)"), ("both", "`o_custkey` > 10 && `o_orderstatus` == 'F'", "o_custkey > 10 and o_orderstatus = 'F'"),
        ("either", "`o_custkey` > 10 || `o_orderstatus` == 'F'", "o_custkey > 10 or o_orderstatus = 'F'"), ("lazy", "if(`o_custkey` % 2 == 0, 0, 10 / (`o_custkey` % 2))", "case when o_custkey % 2 = 0 then 0 else 10 end::bigint"),
        ("bound", "a = `o_custkey` + 1; b = a * 2; b - a", "o_custkey + 1"), ("one_of", "`o_orderstatus` in ['F', 'P']", "o_orderstatus in ('F', 'P')"),
        ("told", "\"order {`o_orderkey`} of {`o_custkey`}: {null}{{x}\"", "'order ' || o_orderkey || ' of ' || o_custkey || ': {x}'"),
    ]),
    "expr_string": ("part", "p_partkey", [
        ("whole", "concat(`p_brand`, ' / ', `p_type`)", "p_brand || ' / ' || p_type"), ("second", "charAt(`p_name`, 1)", "p_name[2]"), ("beyond", "charAt(`p_name`, 1000)", "null::varchar"),
        ("upper_case", "upper(`p_name`)", "upper(p_name)"), ("lower_case", "lower(`p_type`)", "lower(p_type)"), ("bare", "trim(concat(' \t', `p_name`, '\n '))", "p_name"),
        ("swapped", "replace(`p_name`, 'a', 'AA')", "replace(p_name, 'a', 'AA')"), ("between", "replace('ab', '', '-')", "'-a-b-'"), ("begins", "startsWith(`p_type`, 'S')", "starts_with(p_type, 'S')"),
        ("ends", "endsWith(`p_type`, 'L')", "ends_with(p_type, 'L')"), ("has", "contains(`p_name`, 'e')", "contains(p_name, 'e')"), ("place", "indexOf(`p_name`, 'e')", "(instr(p_name, 'e') - 1)::bigint"),
        ("made", "format('{0}:{1}', `p_partkey`, `p_size`)", "p_partkey || ':' || p_size"), ("turned", "reverse(`p_name`)", "reverse(p_name)"), ("again", "repeat(`p_brand`, 2)", "repeat(p_brand, 2)"),
        ("left_padded", "leftPad(toString(`p_size`), 5, '0x')", "lpad(p_size::varchar, 5, '0')"), ("right_padded", "rightPad(`p_brand`, 12)", "rpad(p_brand, greatest(12, length(p_brand))::int, ' ')"), ("never_cut", "leftPad(`p_type`, 2)", "p_type"),
        ("part_of", "`p_name`[1:-1]", "substr(p_name, 2, greatest(length(p_name) - 2, 0))"), ("size_of", "len(`p_name`)", "length(p_name)"), ("text_of", "toString(`p_size` * 1.0)", "p_size::varchar"),
        ("matches", "regexMatch(`p_name`, '[aeiou]{2}')", "regexp_matches(p_name, '[aeiou]{2}')"), ("rewritten", "regexReplace(`p_type`, '([A-Z])([A-Z]+)', '$2-${1}')", "regexp_replace(p_type, '([A-Z])([A-Z]+)', '\\2-\\1', 'g')"),
    ]),
    "expr_array": ("part", "p_partkey", [
        ("n_parts", "len(split(`p_type`, ' '))", "len(string_split(p_type, ' '))"), ("first_part", "split(`p_type`, ' ')[0]", "string_split(p_type, ' ')[1]"), ("last_part", "split(`p_type`, ' ')[-1]", "string_split(p_type, ' ')[-1]"),
        ("soft", "arrayGet(split(`p_type`, ' '), 9, 'none')", "'none'"), ("rejoined", "join(split(`p_type`, ' ')[0:2], '+')", "array_to_string(string_split(p_type, ' ')[1:2], '+')"),
        ("with_null", "join([`p_partkey`, null, 3], '-')", "p_partkey || '--3'"), ("empty", "isEmpty(split(`p_type`, ' '))", "false"), ("kept", "len(filterNotNull([nullIf(`p_size`, 1), 2]))", "if(p_size = 1, 1, 2)"),
        ("inside", "`p_size` in [1, 5, 9]", "p_size in (1, 5, 9)"), ("position", "indexOf([10, 20, `p_size` * 1], `p_size` * 1)", "case p_size when 10 then 0 when 20 then 1 else 2 end::bigint"),
        ("chars", "len(split(`p_name`, ''))", "length(p_name)"), ("backward", "join(reverse([1, 2, 3]), '')", "'321'"), ("added", "join([1] + [`p_size`], ',')", "'1,' || p_size"),
    ]),
    "expr_object": ("supplier", "s_suppkey", [
        ("value_of", "{\"name\" = `s_name`, \"n\" = `s_nationkey`}[\"name\"]", "s_name"), ("key_at", "objectKeys({\"z\" = 1, \"a\" = 2}, 0)", "'z'"), ("value_at", "objectValues({\"z\" = `s_nationkey`, \"a\" = 2}, 0)", "s_nationkey"),
        ("has_key", "objectHasKey({\"z\" = 1}, 'a')", "false"), ("got", "objectGet({\"z\" = `s_name`}, 'z')", "s_name"), ("n_keys", "len(fields(\"s_suppkey, s_name\"))", "2::bigint"),
        ("as_json", "toString({\"k\" = `s_suppkey`})", "'{\"k\":' || s_suppkey || '}'"), ("whole_row", "jsPathString(toJson(fields(\"*\")), '$.s_name')", "s_name"),
    ]),
    "expr_json": ("events", "event_id", [
        ("text_at", "jsPathString(parseJson('{\"a\": {\"b\": \"x\"}}'), '$.a.b')", "'x'"), ("number_as_text", "jsPathString(toJson({\"a\" = `user_id`}), '$.a')", "null::varchar"),
        ("whole_at", "jsPathInt(toJson({\"a\" = [`user_id`, 2]}), '$.a[0]')", "user_id"), ("text_as_whole", "jsPathInt(parseJson('{\"a\": \"5\"}'), '$.a')", "null::bigint"),
        ("float_at", "jsPathFloat(toJson({\"v\" = `value`}), '$.v')", "value"), ("bool_at", "jsPathBool(toJson({\"big\" = `value` > 50}), '$.big')", "value > 50"),
        ("deep", "jsPathInt(toJson({\"a\" = {\"b\" = `user_id`}}), '$..b')", "user_id"), ("keys_of", "len(parseJson('{\"a\": 1, \"b\": 2}'))", "2::bigint"),
        ("member", "toString(parseJson('{\"a\": [1, 2]}')[\"a\"][1])", "'2'"), ("found", "contains(parseJson('[1, 2, 3]'), 2)", "true"),
    ]),
    "expr_datetime": ("orders", "o_orderkey", [
        ("year_of", "year(`o_orderdate`)", "year(o_orderdate)"), ("month_of", "month(`o_orderdate`)", "month(o_orderdate)"), ("day_of", "day(`o_orderdate`)", "day(o_orderdate)"), ("hour_of", "hour(`o_orderdate`)", "hour(o_orderdate)"),
        ("minute_of", "minute(`o_orderdate`)", "minute(o_orderdate)"), ("second_of", "second(`o_orderdate`)", "second(o_orderdate)"), ("milli_of", "millisecond(`o_orderdate`)", "(millisecond(o_orderdate) % 1000)::bigint"),
        ("weekday_of", "dayOfWeek(`o_orderdate`)", "isodow(o_orderdate)"), ("yearday_of", "dayOfYear(`o_orderdate`)", "dayofyear(o_orderdate)"), ("seconds_of", "toSeconds(`o_orderdate`)", "floor(epoch(o_orderdate))::bigint"), ("millis_of", "toMillis(`o_orderdate`)", "epoch_ms(o_orderdate)"),
        ("from_s", "toString(fromSeconds(`o_orderkey`))", "strftime(to_timestamp(o_orderkey)::timestamp, '%Y-%m-%dT%H:%M:%S+00:00')"), ("from_ms", "toMillis(fromMillis(`o_orderkey`))", "o_orderkey"),
        ("days_on", "toString(addDays(`o_orderdate`, 45))", "strftime(o_orderdate + interval 45 day, '%Y-%m-%dT%H:%M:%S+00:00')"), ("hours_back", "toString(subtractHours(`o_orderdate`, 5))", "strftime(o_orderdate - interval 5 hour, '%Y-%m-%dT%H:%M:%S+00:00')"),
        ("minutes_on", "toSeconds(addMinutes(`o_orderdate`, 90))", "floor(epoch(o_orderdate + interval 90 minute))::bigint"), ("seconds_back", "toSeconds(subtractSeconds(`o_orderdate`, 61))", "floor(epoch(o_orderdate - interval 61 second))::bigint"),
        ("millis_on", "toMillis(addMilliseconds(`o_orderdate`, 5))", "epoch_ms(o_orderdate) + 5"), ("days_back", "toMillis(subtractDays(`o_orderdate`, 2)) - toMillis(subtractMinutes(subtractMilliseconds(`o_orderdate`, 1), 1))", "(60001 - 2 * 86400000)::bigint"),
        ("hours_on", "toMillis(addHours(`o_orderdate`, 1)) - toMillis(addSeconds(`o_orderdate`, 1))", "3599000::bigint"),
        ("months_on", "toString(addMonths(`o_orderdate`, 1))", "strftime(o_orderdate + interval 1 month, '%Y-%m-%dT%H:%M:%S+00:00')"), ("months_back", "toString(subtractMonths(`o_orderdate`, 3))", "strftime(o_orderdate - interval 3 month, '%Y-%m-%dT%H:%M:%S+00:00')"),
        ("years_on", "toString(addYears(`o_orderdate`, 1))", "strftime(o_orderdate + interval 1 year, '%Y-%m-%dT%H:%M:%S+00:00')"), ("years_back", "toString(subtractYears(`o_orderdate`, 4))", "strftime(o_orderdate - interval 4 year, '%Y-%m-%dT%H:%M:%S+00:00')"),
        ("days_between", "dateDiff('day', `o_orderdate`, toTimestamp('2000-01-01T00:00:00Z'))", "trunc(epoch(timestamp '2000-01-01' - o_orderdate) / 86400)::bigint"), ("shown", "formatDateTime(`o_orderdate`, '%d.%m.%Y %H:%M %j')", "strftime(o_orderdate, '%d.%m.%Y %H:%M %j')"),
        ("clock_year", "year(now())", "2024::bigint"), ("clock_day", "toString(today())", "'2024-02-29'"), ("clock_text", "toString(now())", "'2024-02-29T12:30:15.250+00:00'"),
    ]),
    "expr_math": ("lineitem", "l_orderkey, l_linenumber", [
        ("a", "sin(`l_quantity`)", "sin(l_quantity)"), ("b", "cos(`l_quantity`)", "cos(l_quantity)"), ("c", "tan(`l_tax`)", "tan(l_tax)"), ("d", "asin(`l_tax`)", "asin(l_tax)"), ("f", "acos(`l_tax`)", "acos(l_tax)"), ("g", "atan(`l_quantity`)", "atan(l_quantity)"),
        ("h", "atan2(`l_tax`, `l_quantity`)", "atan2(l_tax, l_quantity)"), ("i", "log(`l_quantity`)", "ln(l_quantity)"), ("j", "log2(`l_quantity`)", "log2(l_quantity)"), ("k", "log10(`l_quantity`)", "log10(l_quantity)"), ("l", "exp(`l_tax`)", "exp(l_tax)"),
        ("m", "cbrt(`l_quantity`)", "cbrt(l_quantity)"), ("n", "sinh(`l_tax`)", "sinh(l_tax)"), ("o", "cosh(`l_tax`)", "cosh(l_tax)"), ("p", "tanh(`l_tax`)", "tanh(l_tax)"), ("q", "asinh(`l_quantity`)", "asinh(l_quantity)"), ("r", "acosh(`l_quantity`)", "acosh(l_quantity)"),
        ("s", "atanh(`l_tax`)", "atanh(l_tax)"), ("t", "pi() + e()", "pi() + exp(1)"), ("u", "tau() - 2 * pi()", "0.0::double"), ("v", "phi()", "(1 + sqrt(5)) / 2"), ("w", "clamp(`l_quantity`, 10, 20)", "greatest(10, least(l_quantity, 20))::double"),
        ("x", "isNaN(log(-`l_quantity`))", "true"), ("y", "isInfinite(log(0 * `l_quantity`))", "true"),
    ]),
    "expr_special": ("lineitem", "l_orderkey, l_linenumber", [
        ("a", "gamma(`l_tax` + 1)", "gamma(l_tax + 1)"), ("b", "lnGamma(`l_quantity`)", "lgamma(l_quantity)"), ("c", "beta(`l_tax` + 1, 2)", "gamma(l_tax + 1) * gamma(2) / gamma(l_tax + 3)"),
        ("d", "erf(`l_tax`)", _ERF), ("f", "erfc(`l_tax`)", f"1 - ({_ERF})"), ("g", "lambertW(`l_quantity`) * exp(lambertW(`l_quantity`))", "l_quantity"),
    ]),
    "expr_bitwise": ("orders", "o_orderkey", [
        ("a", "`o_orderkey` & 255", "o_orderkey & 255"), ("b", "`o_orderkey` | 1024", "o_orderkey | 1024"), ("c", "`o_orderkey` ^ `o_custkey`", "xor(o_orderkey, o_custkey)"), ("d", "~`o_orderkey`", "~o_orderkey"), ("f", "`o_orderkey` << 3", "o_orderkey * 8"),
        ("g", "`o_orderkey` >> 2", "o_orderkey >> 2"), ("h", "bitCount(`o_orderkey`)", "bit_count(o_orderkey)::bigint"), ("i", "0xFF", "255::bigint"),
    ]),
    "expr_bytes": ("documents", "doc_id", [
        ("n_bytes", "byteLength(bytesFromUtf8(`text`))", "octet_length(encode(text))"), ("first_byte", "byteAt(bytesFromUtf8(`text`), 0)", "('0x' || substr(hex(encode(text)), 1, 2))::bigint"), ("no_byte", "byteAt(bytesFromUtf8(`source`), 1000)", "null::bigint"),
        ("hexed", "hex(bytesFromUtf8(`source`))", "lower(hex(encode(source)))"), ("based", "base64(bytesFromUtf8(`text`))", "base64(encode(text))"), ("url_based", "base64Url(bytesFromUtf8(`source`))", "rtrim(replace(replace(base64(encode(source)), '+', '-'), '/', '_'), '=')"),
        ("back", "decodeText(bytesFromBase64(base64(bytesFromUtf8(`source`))), 'utf-8')", "source"), ("unhexed", "decodeText(bytesFromHex(hex(bytesFromUtf8(`source`))), 'utf-8')", "source"), ("alike", "bytesEqual(bytesFromUtf8(`source`), bytesFromUtf8('src1'))", "source = 'src1'"),
        ("escaped", "urlEncode(`source` + ' ~*é')", "source || '%20~%2A%C3%A9'"), ("unescaped", "urlDecode(`source` + '%20+')", "source || ' +'"), ("coded", "encode(bytesFromUtf8(`lang`), 'hex')", "lower(hex(encode(lang)))"),
        ("decoded", "decodeText(decode(encode(bytesFromUtf8(`lang`), 'base64url'), 'base64url'), 'utf-8')", "lang"), ("latin", "hex(encodeText('é', 'windows-1252'))", "'e9'"),
    ]),
    "expr_digest": ("documents", "doc_id", [
        ("a", "md5(`text`)", "md5(text)"), ("b", "sha1(`text`)", "sha1(text)"), ("c", "sha256(`text`)", "sha256(text)"), ("d", "len(sha512(`text`))", "128::bigint"), ("f", "hmac('sha256', `source`, 'k')", "sha256(unhex('37' || repeat('5c', 63)) || unhex(sha256(unhex('5d' || repeat('36', 63)) || encode(source))))"),
        ("h", "sha512('abc')", "'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'"),
        ("g", "hmac('sha256', 'msg', 'key')", "'2d93cbc1be167bcb1637a4a23cbff01a7878f0c50ee833954ea5221bb1b8c628'"),
    ]),
    "expr_hash": ("documents", "doc_id", [("a", "xxHash64(`text`)", None), ("b", "xxHash32(`text`)", None), ("c", "cityHash64(`source`)", None), ("d", "sipHash64(`source`)", None)]),
    # Published vectors of the hashes, as the signed numbers of their bits; fixed values.
    "expr_hash_vectors": ("nation", "n_nationkey", [
        ("a", "xxHash64('')", f"{0xEF46DB3751D8E999 - 2**64}::bigint"), ("b", "xxHash64('abc')", f"{0x44BC2CF5AD770999}::bigint"), ("c", "xxHash32('')", f"{0x02CC5D05}::bigint"), ("d", "xxHash32('abc')", f"{0x32D153FF}::bigint"),
        ("f", "sipHash64('')", f"{0x1E924B9D737700D7}::bigint"), ("g", "cityHash64('')", f"{0x9AE16A3B2F90404F - 2**64}::bigint"),
    ]),
    "expr_fnv": ("documents", "doc_id", [("f", "fnv1a64(`source`)", _FNV), ("g", "fnv1a64('')", "(14695981039346656037::hugeint - 18446744073709551616)::bigint"), ("h", "fnv1a64('a')", "(12638187200555641996::hugeint - 18446744073709551616)::bigint")]),
    "expr_cast": ("customer", "c_custkey", [
        ("a", "toInt8(`c_nationkey`)", "c_nationkey::bigint"), ("b", "toInt16(`c_acctbal`)", "trunc(c_acctbal)::bigint"), ("c", "toInt32(toString(`c_custkey`))", "c_custkey"), ("d", "toInt64(`c_acctbal`)", "trunc(c_acctbal)::bigint"), ("f", "toUInt8(`c_nationkey`)", "c_nationkey::bigint"),
        ("g", "toUInt16(`c_custkey` % 65536)", "c_custkey % 65536"), ("h", "toUInt32(`c_custkey`)", "c_custkey"), ("i", "toString(toUInt64(`c_custkey`))", "c_custkey::varchar"), ("j", "toFloat64(toString(`c_nationkey`))", "c_nationkey::double"), ("k", "toFloat64(toFloat32(`c_nationkey`))", "c_nationkey::double"),
        ("l", "toBool(`c_nationkey` * 1)", "c_nationkey <> 0"), ("m", "toBool('no') || toBool('maybe')", "true"), ("n", "toString(toDate('2024-02-29'))", "'2024-02-29'"), ("o", "toSeconds(toTimestamp('2024-02-29T01:00:00+01:00'))", "epoch(timestamp '2024-02-29')::bigint"),
        ("p", "toUuid('A0EEBC999C0B4EF8BB6D6BB9BD380A11')", "'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11'"), ("q", "toString(toBigInt(`c_custkey`) * 1000000000000)", "(c_custkey::hugeint * 1000000000000)::varchar"), ("r", "toString(toDecimal('12.3456', 10, 2))", "'12.34'"),
        ("s", "toStringCast(`c_custkey`)", "c_custkey::varchar"), ("t", "typeof(`c_acctbal`)", "'Float64'"), ("u", "env('RIVERBEND_NO_SUCH_NAME', 'd')", "'d'"), ("v", "seconds(objectId('507f1f77bcf86cd799439011'))", "1350508407::bigint"), ("w", "byteLength(newObjectId())", "12::bigint"),
    ]),
    "expr_random": ("nation", "n_nationkey", [
        ("a", "x = randomInt(1, 6); x >= 1 && x <= 6", "true"), ("b", "x = randomFloat(0, 1); x >= 0 && x < 1", "true"), ("c", "regexMatch(toString(randomUuid()), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$')", "true"),
        ("d", "regexMatch(randomAlphanumeric(20), '^[0-9A-Za-z]{20}$')", "true"), ("f", "regexMatch(randomHex(40), '^[0-9a-f]{40}$')", "true"), ("g", "byteLength(randomBytes(300))", "300::bigint"), ("h", "randomChoice('a', 'b', 'c') in ['a', 'b', 'c']", "true"),
        ("i", "randomInt(1, 100, 7) == randomInt(1, 100, 7)", "true"),
    ]),
    "expr_paths": ("customer", "c_custkey", [
        ("a", "toString(jsPath(toJson({\"k\" = [`c_custkey`, {\"n\" = `c_name`}]}), '$.k[1]'))", "'{\"n\":\"' || c_name || '\"}'"), ("b", "toString(jsPath(parseJson('{\"a\": 1}'), '$.b'))", "null::varchar"),
        ("c", "toString(jsPath(toJson({\"k\" = [`c_custkey`, 2]}), '$.k'))", "'[' || c_custkey || ',2]'"), ("d", "len(file('values.py')) > 100", "true"), ("f", "startsWith(file('__init__.py'), '\"\"\"')", "true"),
    ]),
}


def expression_query(spec: tuple[str, str, list], spark: SparkSession, sf_dir: str) -> DataFrame:
    source, keys, columns = spec
    df = table(spark, sf_dir, source)
    compiler = Compiler(Context(mapping.source_types(df), CLOCK, folder=str(Path(syntax.__file__).parent)))
    made = []
    for name, text, _ in columns:
        v = compiler.compile(parse(text))
        col = v.col.cast("bigint") if v.type.is_integer and v.type.kind != "BigInt" else F.round(v.col.cast("double"), 6) if v.type.is_float else v.col
        made.append(col.alias(name))
    return df.select(*[F.col(k.strip()) for k in keys.split(",")], *made)


#: Columns of expression queries that are floats, and so rounded on both sides.
_FLOATS = {"expr_arithmetic": {"total", "square", "root"}, "expr_json": {"float_at"}, "expr_math": set("abcdfghijklmnopqrstuvw"), "expr_special": set("abcdfg"), "expr_cast": {"j", "k"}}


def expression_sql(name: str) -> str | None:
    source, keys, columns = EXPRESSIONS[name]
    if any(sql is None for _, _, sql in columns):
        return None
    body = ", ".join(f"round({sql}, 6) AS {n}" if n in _FLOATS.get(name, ()) else f"{sql} AS {n}" for n, _, sql in columns)
    return f"SELECT {keys}, {body} FROM {source}"


FLOW = {
    "sources": [{"name": "src", "type": "parquet", "config": {"path": "."}}], "sinks": [{"name": "out", "type": "parquet", "config": {"path": ".", "columns": {
        "orders_enriched": "id bigint not null, customer bigint, status string, total decimal(14,2), label string, priority int, full_name string, placed_on date, ingested_at timestamp"}}}],
    "storages": [{"name": "state", "type": "parquet", "config": {"path": "."}}],
    "flow": {"orders": {
        "source": "src", "sink": "out", "storage": "state", "from": "orders", "to": "orders_enriched", "cursor": {"fields": ["o_orderkey"]},
        "mapping": {
            "id": "o_orderkey", "customer": "o_custkey", "status": {"from": "o_orderstatus", "switch": {"F": "finished", "O": "open"}, "default": "other"},
            "total": {"compute": "`o_totalprice` * 1.1", "truncate": True, "default": 0}, "placed_on": {"from": "o_orderdate", "truncate": True},
        },
        "compute-mapping": {"label": "if(`o_totalprice` > 150000, 'big', 'small')", "priority": "toInt32(`o_orderpriority`[0:1])", "full_name": "concat('order ', toString(`o_orderkey`), '/', `o_orderstatus`)", "ingested_at": "now()"},
    }},
}


def flow_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An orders flow's whole mapping: rename, lookup, computed columns, conversions to the sink's types."""
    return _shown(bulk(config.build(FLOW).flows["orders"], spark.read.parquet(f"{sf_dir}/orders.parquet"), CLOCK))


def _shown(out: DataFrame) -> DataFrame:
    """The flow's rows with cents, milliseconds and a text for the day, which compare exactly."""
    return out.withColumn("total", (F.col("total") * 100).cast("bigint")).withColumnRenamed("total", "total_cents").withColumn("ingested_at", F.unix_millis("ingested_at")).withColumn("placed_on", F.date_format("placed_on", "yyyy-MM-dd"))


def keyset_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of 500 rows after a two-column cursor (the limit is the feature)."""
    df = table(spark, sf_dir, "lineitem")
    return keyset.scan(df, ["l_orderkey", "l_linenumber"], (100, 2), True, 500).select("l_orderkey", "l_linenumber", "l_partkey")


def keyset_null_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending with nulls last, after a state whose first field is 3."""
    df = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 7).alias("rank"), F.col("o_orderkey").alias("id"))
    return keyset.scan(df, ["rank", "id"], (3, 100), False)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as change events of users."""
    op = F.when(F.col("event_id") % 11 == 0, F.lit("delete")).when(F.col("event_id") % 3 == 0, F.lit("insert")).otherwise(F.lit("update"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", op.alias("operation"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each key."""
    return changes.latest(changes.tag(_events(spark, sf_dir), "operation"), ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value", F.col(changes.OP).alias("op"))


_CHANGES_SQL = "SELECT user_id, event_id, event_type, value, CASE WHEN event_id % 11 = 0 THEN 'D' ELSE 'U' END AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def _merge(strategy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer after a batch of changed, new and deleted rows."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    batch = old.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), "c_acctbal", F.lit("U").alias(changes.OP))
    more = old.where("c_custkey % 10 = 1").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", "c_acctbal", F.lit("U").alias(changes.OP))
    gone = old.where("c_custkey % 7 = 0").select("c_custkey", "c_name", "c_acctbal", F.lit("D").alias(changes.OP))
    return merged(old, batch.unionByName(more).unionByName(gone), Conflict(("c_custkey",), strategy))


def _merge_sql(name: str) -> str:
    return (f"SELECT c_custkey, {name} AS c_name, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 UNION ALL "
            "SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 1")


def mapping_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wildcard over a sink's columns, one of them nullable and without a source, beside a packed row."""
    df = table(spark, sf_dir, "nation")
    sink = {"n_nationkey": (L.INT64, False), "n_name": (L.TEXT, True), "n_extra": (L.TEXT, True), "n_regionkey": (L.TEXT, True)}
    out = mapping.apply(df, mapping.rules({"*": "*"}), sink)
    packed = mapping.apply(df, mapping.rules({"k": "n_nationkey", "body": "*"})).select(F.col("k").cast("bigint").alias("n_nationkey"), F.try_variant_get("body", "$.n_name", "string").alias("packed_name"))
    return out.join(packed, "n_nationkey")


def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup against a table, with a default for misses."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return lookup.lookup_table(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nations, "k", "v", "none", "nation")


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions of the lattice, lossless and truncating."""
    df = table(spark, sf_dir, "lineitem")
    types = mapping.source_types(df)
    ctx = Context(types)
    price, number, part, flag, day = (ctx.column(c) for c in ("l_extendedprice", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate"))
    lossy = partial(convert, truncate=True)
    return df.select(
        "l_orderkey", "l_linenumber",
        convert(number, L.INT64).col.alias("widened"), lossy(part, L.INT8).col.cast("bigint").alias("saturated"), lossy(price, L.INT32).col.cast("bigint").alias("cut"), lossy(price, L.INT16).col.cast("bigint").alias("small"),
        lossy(price, L.BOOL).col.alias("truth"), (lossy(price, L.decimal(12, 1)).col * 10).cast("bigint").alias("fixed_tenths"), convert(number, L.TEXT).col.alias("words"), lossy(flag, L.Type("Text", size=1)).col.alias("short"),
        F.date_format(lossy(day, L.DATE).col, "yyyy-MM-dd").alias("day"), convert(number, L.FLOAT64).col.alias("real"), convert(number, L.BOOL).col.alias("some"),
    )


def _local() -> str:
    """A temporary folder on the driver's host, for databases that are files there; it goes with the driver."""
    folder = tempfile.mkdtemp(prefix="riverbend-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared one; in local mode without one, a temporary folder that goes with the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        root = _local()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _linked(spark: SparkSession, sf_dir: str) -> tuple[config.Flow, config.Config]:
    """The orders flow on the given tables, with upserts."""
    root = scratch(spark, "flow")
    raw = copy.deepcopy(FLOW)
    raw["sources"][0]["config"]["path"] = sf_dir
    raw["sinks"][0]["config"]["path"], raw["storages"][0]["config"]["path"] = f"{root}/out", f"{root}/state"
    raw["flow"]["orders"]["conflict"] = {"key": ["id"], "strategy": "overwrite"}
    made = config.build(raw)
    return made.flows["orders"], made


def flow_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders flow from end to end: batches by cursor, mapping, upserts into a merge table, saved cursors; then the table is read."""
    flow, made = _linked(spark, sf_dir)
    Runner(spark, flow, made.storages[flow.storage], now=lambda: CLOCK).once()  # one clock for all batches, as the oracle has
    return _shown(MergeTable(spark, f"{flow.sink.config['path']}/{flow.target}", flow.sink.schema(spark, flow.target), flow.conflict).read())


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream of users into a merge table by Structured Streaming, drained; then the table is read."""
    root = scratch(spark, "changes")
    _events(spark, sf_dir).write.parquet(f"{root}/events/users.parquet")
    raw = {
        "sources": [{"name": "s", "type": "cdc", "config": {"path": f"{root}/events", "order": "event_id"}}], "sinks": [{"name": "o", "type": "parquet", "config": {"path": f"{root}/out"}}],
        "storages": [{"name": "st", "type": "files", "config": {"path": f"{root}/state"}}],
        "flow": {"users": {"source": "s", "sink": "o", "storage": "st", "from": "users", "to": "users", "mapping": {"id": "user_id", "event": "event_id", "kind": "event_type"}, "conflict": {"key": ["id"], "strategy": "overwrite"}}},
    }
    flow = config.build(raw).flows["users"]
    streaming.start(spark, flow, f"{root}/state", once=True).awaitTermination()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("event", T.LongType()), T.StructField("kind", T.StringType())])
    return MergeTable(spark, f"{root}/out/users", schema, flow.conflict).read()


def change_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup on update: the last change of each key, upserts with the present table's row."""
    present = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_events")).where("user_id % 4 <> 0")
    last = changes.latest(changes.tag(_events(spark, sf_dir), "operation"), ["user_id"], "event_id").select("user_id", changes.OP)
    return changes.with_post_images(last, present, ["user_id"]).withColumnRenamed(changes.OP, "op")


def mapping_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested rows by path, as values, in expressions and as cursor."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.struct("s_name", F.col("s_nationkey").alias("nation")).alias("inner"), F.col("s_acctbal").alias("money")).alias("deep"))
    late = keyset.scan(df, ["deep.inner.nation", "s_suppkey"], (12, 5))
    return mapping.apply(late, mapping.rules({"id": "s_suppkey", "name": "deep.inner.s_name", "nation": "deep.inner.nation", "money": "deep.money"}))


def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of nested documents, read by its configured fields after a cursor on a nested one."""
    root = scratch(spark, "documents")
    made = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("_id"), F.struct(F.col("c_nationkey").alias("nation"), F.array("c_mktsegment").alias("tags")).alias("meta"), "c_name")).alias("value"))
    made.write.text(f"{root}/people.jsonl")
    rows = Source("m", "mongodb", {"path": root, "schema": {"_id": "bigint", "meta.nation": "bigint", "c_name": "string"}}).read(spark, "people")
    return keyset.scan(rows, ["meta.nation", "_id"], (3, 50)).select("_id", F.col("`meta.nation`").alias("nation"), "c_name", F.try_variant_get("document", "$.meta.tags[0]", "string").alias("segment"))


def jdbc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a database over JDBC and read back by cursor (the database that Spark brings along, embedded: on a cluster the
    driver has it open, and executors read a copy in the shared folder)."""
    folder = _local()
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{folder}/derby.log")
    url = f"jdbc:derby:{folder}/db;create=true"
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    options = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df.limit(0).write.format("jdbc").options(dbtable="supplier", **options).save()
    Sink("d", "postgres", options).write(df, "supplier")
    if embedded.driver_only(spark, url):
        options["url"] = embedded.publish(spark, url, scratch(spark, "database"))
    return keyset.scan(Source("d", "postgres", options).read(spark, "supplier"), ["s_suppkey"], (10,))


def database_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts and deletes run as statements on a database (a local file), then its rows."""
    path = f"{_local()}/x.db"
    held = sqlite3.connect(path)
    held.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT)")
    held.commit()
    sink, rule = Sink("s", "sqlite", {"url": path}), Conflict(("n_nationkey",))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sink.write(nation.coalesce(1), "nation", rule)
    changed = nation.select("n_nationkey", F.lower("n_name").alias("n_name"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("D")).otherwise(F.lit("U")).alias(changes.OP)).where("n_nationkey % 3 <> 1")
    sink.write(changed.coalesce(1), "nation", rule)
    found = held.execute("SELECT n_nationkey, n_name FROM nation").fetchall()
    held.close()
    return spark.createDataFrame(found, "n_nationkey bigint, n_name string")


def key_value_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of a key-value sink: sets with an expiry, and deletes."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 2 == 0, F.make_dt_interval(F.lit(0), F.lit(1))).alias("ttl"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("D")).otherwise(F.lit("U")).alias(changes.OP))
    return command_rows(rows, "kv", "customer:").select(F.array_join("command", "|").alias("command"))


def key_value_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of the other modes: deletes, lists, streams and messages."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"))
    made = [command_rows(nation.select(*columns), mode, "n:").select(F.lit(mode).alias("mode"), F.array_join("command", "|").alias("command")) for mode, columns in (("kv-delete", ["key"]), ("list", ["key", "value"]), ("stream", ["key", "value"]), ("pubsub", ["value"]))]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def column_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column store's row format: a key, a nullable text and a decimal, as hexadecimal digits."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"))
    types = [("c_custkey", L.INT64, False), ("c_name", L.TEXT, True), ("c_acctbal", L.decimal(12, 2), False)]

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({"c_custkey": [r["c_custkey"] for r in rows], "digits": [b"".join(nullable_value(r[n], t, null) for n, t, null in types).hex() for r in rows]})

    return df.mapInArrow(run, "c_custkey bigint, digits string")


def sample_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's sample: so many rows (the limit is the feature), each of them the table's."""
    source = Source("s", "parquet", {"path": sf_dir})
    some = source.sample(spark, "orders", 25)
    return some.join(source.read(spark, "orders"), some.columns, "left_semi").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flow_orders": flow_orders, **{name: partial(expression_query, spec) for name, spec in EXPRESSIONS.items()}, "keyset_batch": keyset_batch, "keyset_null_aware": keyset_null_aware,
    "change_events": change_events, "conflict_overwrite": partial(_merge, "overwrite"), "conflict_ignore": partial(_merge, "ignore"), "mapping_wildcard": mapping_wildcard, "lookup_join": lookup_join, "conversions": conversions,
    **{f.__name__: f for f in (flow_whole, change_stream, change_lookups, mapping_paths, document_source, jdbc_source, database_upserts, key_value_commands, key_value_modes, column_store_rows, sample_probe)},
}

_FLOW_SQL = (
    "SELECT o_orderkey AS id, o_custkey AS customer, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status, (regexp_extract((o_totalprice * 1.1)::varchar, '^-?[0-9]+([.][0-9]{1,2})?')::decimal(14,2) * 100)::bigint AS total_cents, "
                   "if(o_totalprice > 150000, 'big', 'small') AS label, o_orderpriority[1]::int AS priority, 'order ' || o_orderkey || '/' || o_orderstatus AS full_name, strftime(o_orderdate, '%Y-%m-%d') AS placed_on, 1709209815250::bigint AS ingested_at FROM orders"
)


def _little(number: str) -> str:
    """The eight bytes of a number, the lowest first, as hexadecimal digits."""
    return f"array_to_string(list_transform(range(8), lambda i: lpad(hex((({number}) >> (8 * i)::int) & 255), 2, '0')), '')"


ORACLE_SQL: dict[str, str] = {
    "flow_orders": _FLOW_SQL, "flow_whole": _FLOW_SQL,
    "change_stream": "SELECT user_id AS id, event_id AS event, event_type AS kind FROM (" + _CHANGES_SQL + ") WHERE op = 'U'",
    "change_lookups": "SELECT c.user_id, n_events, op FROM (" + _CHANGES_SQL + ") c JOIN (SELECT user_id, count(*) AS n_events FROM events WHERE user_id % 4 <> 0 GROUP BY user_id) p ON c.user_id = p.user_id WHERE op = 'U' "
                      "UNION ALL SELECT user_id, NULL, op FROM (" + _CHANGES_SQL + ") WHERE op = 'D'",
    "mapping_paths": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS money FROM supplier WHERE (s_nationkey, s_suppkey) > (12, 5)",
    "document_source": "SELECT c_custkey AS _id, c_nationkey AS nation, c_name, c_mktsegment AS segment FROM customer WHERE (c_nationkey, c_custkey) > (3, 50)",
    "jdbc_source": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey > 10",
    "database_upserts": "SELECT n_nationkey::bigint AS n_nationkey, if(n_nationkey % 3 <> 1, lower(n_name), n_name) AS n_name FROM nation WHERE n_nationkey % 3 = 1 OR n_nationkey % 5 <> 0",
    "key_value_modes": "SELECT 'kv-delete' AS mode, 'DEL|n:' || n_name AS command FROM nation UNION ALL SELECT 'list', 'RPUSH|n:' || n_name || '|' || n_regionkey FROM nation "
                       "UNION ALL SELECT 'stream', 'XADD|n:' || n_name || '|*|data|' || n_regionkey FROM nation UNION ALL SELECT 'pubsub', 'PUBLISH|n:|' || n_regionkey FROM nation",
    "column_store_rows": f"SELECT c_custkey, lower({_little('c_custkey')} || '00' || lpad(hex(octet_length(encode(c_name))), 2, '0') || hex(encode(c_name)) || {_little('round(c_acctbal * 100)::bigint')}) AS digits FROM customer",
    "sample_probe": "SELECT least(count(*), 25)::bigint AS n FROM orders",
    "key_value_commands": "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'DEL|customer:' || c_custkey ELSE 'SET|customer:' || c_custkey || '|\"' || c_name || '\"' || if(c_custkey % 2 = 0, '|PX|3600000', '') END AS command FROM customer",
    **{name: sql for name in EXPRESSIONS if (sql := expression_sql(name))},
    "keyset_batch": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY l_orderkey, l_linenumber LIMIT 500",
    "keyset_null_aware": "SELECT * FROM (SELECT CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 7 END AS rank, o_orderkey AS id FROM orders) WHERE rank < 3 OR rank IS NULL OR (rank = 3 AND id < 100)",
    "change_events": _CHANGES_SQL, "conflict_overwrite": _merge_sql("CASE WHEN c_custkey % 5 = 0 THEN 'new ' || c_name ELSE c_name END"), "conflict_ignore": _merge_sql("c_name"),
    "mapping_wildcard": "SELECT n_nationkey::bigint AS n_nationkey, n_name, n_regionkey::varchar AS n_regionkey, n_name AS packed_name FROM nation",
    "lookup_join": "SELECT c_custkey, c_nationkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0",
    "conversions": "SELECT l_orderkey, l_linenumber, l_linenumber::bigint AS widened, least(l_partkey, 127)::bigint AS saturated, trunc(l_extendedprice)::bigint AS cut, least(trunc(l_extendedprice), 32767)::bigint AS small, l_extendedprice <> 0 AS truth, "
                   "(regexp_extract(l_extendedprice::varchar, '^-?[0-9]+([.][0-9])?')::decimal(14,1) * 10)::bigint AS fixed_tenths, l_linenumber::varchar AS words, l_returnflag[1] AS short, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linenumber::double AS real, l_linenumber <> 0 AS some FROM lineitem",
}
