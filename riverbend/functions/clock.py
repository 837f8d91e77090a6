"""Dates and instants, all in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbend import types as L
from riverbend.expr.tree import ExprError
from riverbend.expr.values import INTS, Context, Value, constant, function, need


def instant(name: str, v: Value) -> Column:
    return need(name, v, "Timestamp", "Date").col.cast("timestamp")


@function("now", 0)
def now(context: Context) -> Value:
    return Value(context.clock(), L.TIMESTAMP)


@function("today", 0)
def today(context: Context) -> Value:
    return Value(F.to_date(context.clock()), L.DATE)


def _part(name: str, how) -> None:
    @function(name, 1)
    def compiled(_: Context, v: Value) -> Value:
        return Value(how(instant(name, v)).cast("bigint"), L.INT64)


for _name, _how in (
    ("second", F.second), ("minute", F.minute), ("hour", F.hour), ("day", F.day), ("month", F.month), ("year", F.year), ("dayOfYear", F.dayofyear),
    ("millisecond", lambda t: F.pmod(F.unix_millis(t), F.lit(1000))), ("dayOfWeek", lambda t: F.weekday(t) + 1), ("toSeconds", F.unix_seconds), ("toMillis", F.unix_millis),
):
    _part(_name, _how)


def _from(name: str, how) -> None:
    @function(name, 1)
    def compiled(_: Context, n: Value) -> Value:
        return Value(how(need(name, n, *INTS).col.cast("bigint")), L.TIMESTAMP)


_from("fromSeconds", F.timestamp_seconds)
_from("fromMillis", F.timestamp_millis)

# Microseconds of the units of addX and subtractX; fixed values.
_MICROS = {"Days": 86_400_000_000, "Hours": 3_600_000_000, "Minutes": 60_000_000, "Seconds": 1_000_000, "Milliseconds": 1_000}


def _shift(unit: str, sign: int) -> None:
    name = ("add" if sign > 0 else "subtract") + unit

    @function(name, 2)
    def compiled(_: Context, t: Value, n: Value) -> Value:
        by = need(name, n, *INTS).col.cast("bigint") * F.lit(sign * _MICROS[unit])
        return Value(F.timestamp_micros(F.unix_micros(instant(name, t)) + by), L.TIMESTAMP)


def _shift_months(unit: str, months: int, sign: int) -> None:
    name = ("add" if sign > 0 else "subtract") + unit

    @function(name, 2)
    def compiled(_: Context, t: Value, n: Value) -> Value:
        """The day is clamped to the month's end; the time of day stays."""
        by = (need(name, n, *INTS).col.cast("bigint") * F.lit(sign * months)).cast("int")
        return Value(instant(name, t) + F.make_ym_interval(F.lit(0), by), L.TIMESTAMP)


for _sign in (1, -1):
    for _unit in _MICROS:
        _shift(_unit, _sign)
    _shift_months("Months", 1, _sign)
    _shift_months("Years", 12, _sign)


@function("dateDiff", 3)
def date_diff(_: Context, unit: Value, a: Value, b: Value) -> Value:
    """b - a in whole units, truncated toward zero."""
    size = {"second": "Seconds", "minute": "Minutes", "hour": "Hours", "day": "Days"}.get(constant("dateDiff", unit))
    if size is None:
        raise ExprError("dateDiff takes second, minute, hour or day")
    micros = F.unix_micros(instant("dateDiff", b)) - F.unix_micros(instant("dateDiff", a))
    return Value(F.call_function("div", micros, F.lit(_MICROS[size])), L.INT64)


# strftime specifiers and their Java patterns; fixed values.
_MASK = {
    "Y": "yyyy", "y": "yy", "m": "MM", "b": "MMM", "h": "MMM", "B": "MMMM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "a": "E", "A": "EEEE",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "X": "HH:mm:ss", "x": "MM/dd/yy",
}
# Specifiers with no pattern, as functions of the instant; the names are strftime's.
_MADE = {
    "e": lambda t: F.lpad(F.day(t).cast("string"), 2, " "), "k": lambda t: F.lpad(F.hour(t).cast("string"), 2, " "), "l": lambda t: F.lpad((F.pmod(F.hour(t) + 11, F.lit(12)) + 1).cast("string"), 2, " "),
    "s": lambda t: F.unix_seconds(t).cast("string"), "u": lambda t: (F.weekday(t) + 1).cast("string"), "w": lambda t: F.pmod(F.weekday(t) + 1, F.lit(7)).cast("string"),
    "C": lambda t: F.lpad(F.floor(F.year(t) / 100).cast("string"), 2, "0"), "P": lambda t: F.lower(F.date_format(t, "a")), "z": lambda t: F.lit("+0000"), "Z": lambda t: F.lit("UTC"),
    "V": lambda t: F.lpad(F.weekofyear(t).cast("string"), 2, "0"), "G": lambda t: F.year(F.date_add(F.to_date(t), 3 - F.weekday(t))).cast("string"), "c": lambda t: F.concat(F.date_format(t, "E MMM "), F.lpad(F.day(t).cast("string"), 2, " "), F.date_format(t, " HH:mm:ss yyyy")),
    "f": lambda t: F.concat(F.lpad(F.pmod(F.unix_micros(t), F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("000")),
    "U": lambda t: F.lpad(F.floor((F.dayofyear(t) + 6 - F.pmod(F.weekday(t) + 1, F.lit(7))) / 7).cast("string"), 2, "0"),
    "W": lambda t: F.lpad(F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("string"), 2, "0"),
    "n": lambda t: F.lit("\n"), "t": lambda t: F.lit("\t"), "%": lambda t: F.lit("%"),
}
for _digits in (3, 6, 9):
    _MADE[f".{_digits}f"] = lambda t, d=_digits: F.concat(F.lit("."), F.substr(_MADE["f"](t), F.lit(1), F.lit(d)))
    _MADE[f"{_digits}f"] = lambda t, d=_digits: F.substr(_MADE["f"](t), F.lit(1), F.lit(d))


@function("formatDateTime", 2)
def format_date_time(_: Context, t: Value, mask: Value) -> Value:
    """strftime masks, translated when compiling."""
    at, text = instant("formatDateTime", t), constant("formatDateTime", need("formatDateTime", mask, "Text"))
    if text is None:
        return Value(F.lit(None).cast("string"), L.TEXT)
    parts = []
    for piece in re.findall(r"%(?:\.?[369]f|-?.)|%$|[^%]+", text, re.DOTALL):
        if not piece.startswith("%"):
            parts.append(F.lit(piece))
            continue
        name = piece[1:]
        plain = name.startswith("-") and len(name) == 2
        name = name[1:] if plain else name
        if name in _MASK:
            made = F.date_format(at, _MASK[name])
        elif name in _MADE:
            made = _MADE[name](at)
        else:
            raise ExprError(f"formatDateTime: unknown specifier {piece!r}")
        parts.append(F.regexp_replace(made, r"^[0 ]+(?=.)", "") if plain else made)
    return Value(F.when(at.isNotNull(), F.concat(F.lit(""), *parts)), L.TEXT)
