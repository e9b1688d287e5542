"""+ - * / on numbers, texts, dates and intervals; rounding; distance on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from columnade.functions.spec import BindError, FunctionSpec, simple
from columnade.plans import types as t
from columnade.plans.binder import Binder
from columnade.plans.nodes import Call, Lit, Node

_DAY = 86_400
#: From here on a DOUBLE is whole.
_WHOLE = 2.0**53
#: Mean radius of the earth in miles.
EARTH_MILES = 3958.8


def add_interval(at: Column, span: t.Interval, sign: int) -> Column:
    """``at`` moved by ``span`` as a calendar clock is: months first, and what a month lacks in days runs over into the next."""
    seconds = sign * (span.days * _DAY + span.clock_seconds)
    months = sign * span.whole_months
    if not months:
        return F.timestamp_seconds(F.unix_seconds(at) + seconds)
    first = F.add_months(F.trunc(at, "MM"), months)
    day = F.date_add(first, F.dayofmonth(at) - 1)
    clock = F.unix_seconds(at) - F.unix_seconds(F.date_trunc("day", at))
    return F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + clock + seconds)


def _moved(b: Binder, op: str, at: Node, by: Node) -> Node:
    sign = 1 if op == "+" else -1
    nullable = at.nullable or by.nullable
    if by.type == t.INTERVAL:
        return Call(t.DATETIME, at.nullable, op, (at, by), lambda x, _: add_interval(x, by.value, sign))
    if by.type == t.DATETIME and op == "-":
        return Call(t.DOUBLE, nullable, op, (at, by), lambda x, y: (F.unix_seconds(x) - F.unix_seconds(y)).cast("double"))
    if by.type == t.INT:
        return Call(t.DATETIME, nullable, op, (at, by), lambda x, n: F.timestamp_seconds(F.unix_seconds(x) + n.cast("bigint") * (sign * _DAY)))
    if by.type == t.DOUBLE:
        return Call(t.DATETIME, True, op, (at, by), lambda x, n: F.timestamp_seconds(F.unix_seconds(x) + sign * (n * _DAY).try_cast("bigint")))
    raise BindError(f"{op} of DATETIME and {by.type}")


def _binary(op: str) -> FunctionSpec:
    make = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}

    def bind(b: Binder, args: list) -> Node:
        b.want(op, args, 2)
        left, right = args
        if left.type == t.DATETIME and op in "+-":
            if right.type == t.STRING:
                right = b.constant(right, t.DATETIME) if isinstance(right, Lit) else b.to(right, t.DATETIME)
            return Lit(t.DATETIME, True, None) if right.type == t.NULL else _moved(b, op, left, right)
        if right.type == t.INTERVAL and left.type == t.STRING and op in "+-":
            return _moved(b, op, b.constant(left, t.DATETIME) if isinstance(left, Lit) else b.to(left, t.DATETIME), right)
        if t.INTERVAL in (left.type, right.type) or right.type == t.DATETIME:
            raise BindError(f"{op} of {left.type} and {right.type}: the DATETIME stands on the left")
        left, right = b.pair(left, right)
        kind, nullable = left.type, left.nullable or right.nullable
        if kind == t.NULL:
            return Lit(t.DOUBLE, True, None)
        if kind == t.STRING and op == "+":
            return Call(t.STRING, nullable, op, (left, right), F.concat)
        if kind not in (t.INT, t.DOUBLE):
            raise BindError(f"{op} of {left.type} and {right.type}")
        if op == "/":
            return Call(t.DOUBLE, True, op, (left, right), lambda x, y: F.try_divide(x.cast("double"), y.cast("double")))
        return Call(kind, nullable, op, (left, right), make[op])

    return FunctionSpec(op, {"+": "sum; texts are joined, dates move by days or an interval", "-": "difference; of dates in seconds", "*": "product", "/": "quotient, always DOUBLE; by zero NULL"}[op], bind)


def _signed(name: str) -> FunctionSpec:
    def bind(b: Binder, args: list) -> Node:
        (value,) = args
        if value.type not in (t.INT, t.DOUBLE):
            raise BindError(f"{name} of {value.type}")
        return Call(value.type, value.nullable, name, (value,), (lambda x: -x) if name.endswith("-") else (lambda x: x))

    return FunctionSpec(name, "sign", bind)


def _round(b: Binder, args: list) -> Node:
    b.want("ROUND", args, 1, 2)
    value = b.to(args[0], t.DOUBLE)
    if len(args) == 1:
        return Call(t.DOUBLE, value.nullable, "ROUND", (value,), F.round)
    places = b.to(args[1], t.INT)
    if isinstance(places, Lit):
        if places.value is None:
            return Lit(t.DOUBLE, True, None)
        return Call(t.DOUBLE, value.nullable, "ROUND", (value, places), lambda x, _: F.round(x, places.value))

    def made(x: Column, n: Column) -> Column:
        scale = F.pow(F.lit(10.0), n)
        # from 2^53 on there is no fraction left to round; below 10^-308 the scale is zero
        rounded = F.when(F.abs(x * scale) < _WHOLE, F.round(x * scale) / scale).otherwise(x)
        return F.when(x.isNotNull() & n.isNotNull(), F.when(n < -308, F.lit(0.0)).otherwise(rounded))

    return Call(t.DOUBLE, True, "ROUND", (value, places), made)


def _whole(to_whole):
    """FLOOR or CEIL by way of a 64-bit number, where a DOUBLE can have a fraction at all; other values, NaN too, stay."""
    return lambda x: F.when(F.abs(x) < _WHOLE, to_whole(x).cast("double")).otherwise(x)


def _distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_MILES * F.atan2(F.sqrt(a), F.sqrt(1 - a))


SPECS = [
    *(_binary(op) for op in "+-*/"),
    *(_signed(f"unary {op}") for op in "+-"),
    FunctionSpec("ROUND", "nearest whole number, or to so many places; halves away from zero", _round),
    simple("FLOOR", "largest whole number not above, as DOUBLE", (t.DOUBLE,), t.DOUBLE, _whole(F.floor)),
    simple("CEIL", "smallest whole number not below, as DOUBLE", (t.DOUBLE,), t.DOUBLE, _whole(F.ceil)),
    simple("GEO_DISTANCE", "great-circle distance in miles of (lat1, lon1) and (lat2, lon2) in degrees", (t.DOUBLE,) * 4, t.DOUBLE, _distance),
]
