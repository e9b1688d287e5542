"""Conversions between types: of constants in Python, of columns by built-in expressions."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from columnade.plans import types as t
from columnade.plans.nodes import Call, Lit, Node


def datetime_text(seconds: int) -> str:
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S")


def _string_number(text: str, pattern: str):
    m = re.match(pattern, text)
    return m and m[1]


def in_int(value: float) -> int | None:
    """A number without its fraction where that is an INT (32 bits, as try_cast of a column has it), else None."""
    return int(value) if abs(value) < 1 << 32 and -(1 << 31) <= int(value) < 1 << 31 else None


def as_datetime(seconds: float) -> int | None:
    """Seconds as a DATETIME: the first or last one that Spark holds where they go beyond it, None beyond 64 bits."""
    return max(-t.LAST_SECOND, min(t.LAST_SECOND, int(seconds))) if abs(seconds) < 2.0**63 else None


_INT_PREFIX = r"^\s*([+-]?\d+)"
_DOUBLE_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def convert_value(value, source: str, target: str):
    """A constant as another type; None where it cannot be said, KeyError where the pair is unsupported."""
    if source == target or value is None:
        return value
    if source == t.INTERVAL:
        if target == t.STRING:
            return value.text
        raise KeyError
    if (source, target) in ((t.DATETIME, t.INT), (t.DATETIME, t.DOUBLE), (t.DATETIME, t.BOOL), (t.BOOL, t.DATETIME)) or target in (t.INTERVAL, t.NULL):
        raise KeyError
    if target == t.STRING:
        if source == t.BOOL:
            return "true" if value else "false"
        if source == t.DOUBLE:
            return f"{value:f}"
        return datetime_text(value) if source == t.DATETIME else str(value)
    if source == t.STRING:
        if target == t.BOOL:
            return {"true": True, "1": True, "false": False, "0": False}.get(value.lower())
        if target == t.DATETIME:
            return t.parse_datetime(value)
        found = _string_number(value, _INT_PREFIX if target == t.INT else _DOUBLE_PREFIX)
        return found and (in_int(int(found)) if target == t.INT else float(found))
    if target == t.BOOL:
        return value != 0
    if target == t.DATETIME:
        return as_datetime(value)
    if target == t.INT and source == t.DOUBLE:
        return in_int(value)
    return float(value) if target == t.DOUBLE else int(value)


#: Marks a text that a date pattern has rewritten to fields.
_MARK = "\u0001"


def _string_datetime(c: Column) -> Column:
    """Each pattern rewrites the text that it matches to its fields; a lambda's argument makes it once a row, however often a field is used."""
    java = lambda p: p.replace("^ *", "(?s)^ *")
    fields = F.regexp_replace(c, java(t.YEAR_FIRST), f"{_MARK}|$1|$2|$3|$4|$5|$6|$7")
    fields = F.regexp_replace(fields, java(t.MONTH_FIRST), f"{_MARK}|$3|$1|$2|$4|$5|$6|$7")

    def seconds(parts: Column) -> Column:
        # the patterns let digits through only; a cast that fails would cost an exception
        number = lambda k, default: F.when(F.get(parts, F.lit(k)) == "", F.lit(default)).otherwise(F.get(parts, F.lit(k)).cast("int"))
        year, second, zone = number(1, 0), number(6, 0), F.get(parts, F.lit(7))
        made = F.try_make_timestamp(year, number(2, 1), number(3, 1), number(4, 0), number(5, 0), second.cast("decimal(16,6)"))
        apart = F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, -2, 2).cast("int") * 60
        shift = F.when(F.length(zone) < 2, F.lit(0)).when(F.startswith(zone, F.lit("-")), -apart).otherwise(apart)
        return F.when((F.get(parts, F.lit(0)) == _MARK) & (year > 0) & (second < 60), F.unix_seconds(made) - shift)

    found = F.get(F.transform(F.array(F.split(fields, r"\|", -1)), seconds), F.lit(0))
    return F.timestamp_seconds(F.when(~F.contains(c, F.lit(_MARK)), found))


def _seconds_datetime(c: Column) -> Column:
    return F.timestamp_seconds(F.greatest(F.least(c, F.lit(t.LAST_SECOND)), F.lit(-t.LAST_SECOND)))


def _double_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%f", c))


_COLUMNS = {
    (t.BOOL, t.INT): lambda c: c.cast("int"),
    (t.BOOL, t.DOUBLE): lambda c: c.cast("double"),
    (t.BOOL, t.STRING): lambda c: c.cast("string"),
    (t.INT, t.BOOL): lambda c: c != 0,
    (t.INT, t.DATETIME): _seconds_datetime,
    (t.INT, t.DOUBLE): lambda c: c.cast("double"),
    (t.INT, t.STRING): lambda c: c.cast("string"),
    (t.DOUBLE, t.BOOL): lambda c: c != 0,
    (t.DOUBLE, t.DATETIME): lambda c: _seconds_datetime(c.try_cast("bigint")),
    (t.DOUBLE, t.INT): lambda c: c.try_cast("int"),
    (t.DOUBLE, t.STRING): _double_text,
    (t.STRING, t.BOOL): lambda c: F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False),
    (t.STRING, t.INT): lambda c: F.nullif(F.regexp_extract(c, _INT_PREFIX, 1), F.lit("")).try_cast("int"),
    (t.STRING, t.DOUBLE): lambda c: F.nullif(F.regexp_extract(c, _DOUBLE_PREFIX, 1), F.lit("")).try_cast("double"),
    (t.STRING, t.DATETIME): _string_datetime,
    (t.DATETIME, t.STRING): lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
}


def convert(node: Node, target: str) -> Node:
    """``node`` as ``target``; KeyError where there is no such conversion."""
    if node.type == target:
        return node
    if node.type == t.NULL:
        return Lit(target, True, None)
    if isinstance(node, Lit):
        value = convert_value(node.value, node.type, target)
        return Lit(target, value is None, value)
    return Call(target, node.nullable or node.type in (t.STRING, t.DOUBLE), f"CONVERT {target}", (node,), _COLUMNS[node.type, target])
