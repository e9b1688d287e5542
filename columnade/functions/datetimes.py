"""Dates and times: whole seconds, UTC."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from columnade.functions.spec import BindError, FunctionSpec, simple
from columnade.plans import types as t
from columnade.plans.binder import Binder
from columnade.plans.nodes import Call, Lit, Node

FIELDS = {
    "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
    "QUARTER": F.quarter, "WEEK": F.weekofyear, "DOY": F.dayofyear, "DAYOFYEAR": F.dayofyear,
    "DOW": lambda d: F.dayofweek(d) - 1, "DAYOFWEEK": lambda d: F.dayofweek(d) - 1,
    "ISODOW": lambda d: F.weekday(d) + 1, "ISODAYOFWEEK": lambda d: F.weekday(d) + 1,
}


def _date(b: Binder, node: Node) -> Node:
    return b.constant(node, t.DATETIME) if isinstance(node, Lit) and node.type == t.STRING else b.to(node, t.DATETIME)


def _field(b: Binder, name: str, field: Node, value: Node) -> Node:
    if not isinstance(field, Lit) or str(field.value).upper() not in FIELDS:
        raise BindError(f"{name} has no field {field.value if isinstance(field, Lit) else 'that varies'}")
    at = _date(b, value)
    return Call(t.INT, at.nullable, f"{name} {str(field.value).upper()}", (at,), FIELDS[str(field.value).upper()])


def _part_of(name: str) -> FunctionSpec:
    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, 2)
        return _field(b, name, *args)

    return FunctionSpec(name, f"a field of a date: {', '.join(FIELDS)}", bind)


def _short(name: str) -> FunctionSpec:
    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, 1)
        return _field(b, name, Lit(t.STRING, False, name), args[0])

    return FunctionSpec(name, f"the field {name} of a date", bind)


def _years(d: Column, step: int, base: int = 0) -> Column:
    year = F.floor((F.year(d) - base) / step) * step + base
    return F.make_timestamp(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def _truncated(b: Binder, args: list) -> Node:
    b.want("DATE_TRUNC", args, 2)
    part, at = args
    if not isinstance(part, Lit) or part.type != t.STRING:
        raise BindError("DATE_TRUNC wants a constant part")
    if at.type not in (t.DATETIME, t.NULL):
        raise BindError(f"DATE_TRUNC wants DATETIME, not {at.type}")
    at, name = b.to(at, t.DATETIME), part.value.lower()
    if name in ("second", "minute", "hour", "day", "month", "quarter", "year"):
        make = lambda d: F.date_trunc(name, d)
    elif name == "week":
        make = lambda d: F.date_sub(F.to_date(d), F.dayofweek(d) - 1).cast("timestamp")
    elif name in ("decade", "century", "millennium"):
        base = 1900 if b.compat and name == "millennium" else 0
        make = lambda d: _years(d, {"decade": 10, "century": 100, "millennium": 1000}[name], base)
    else:
        raise BindError(f"DATE_TRUNC has no part {part.value}")
    return Call(t.DATETIME, at.nullable, f"DATE_TRUNC {name}", (at,), make)


def _to_zone(b: Binder, args: list) -> Node:
    b.want("CONVERT_TZ", args, 2)
    at, zone = _date(b, args[0]), b.to(args[1], t.STRING)
    if isinstance(zone, Lit):
        if zone.value is None:
            return Lit(t.DATETIME, True, None)
        if zone.value not in zoneinfo.available_timezones():
            raise BindError(f"unknown time zone {zone.value}")
        return Call(t.DATETIME, at.nullable, "CONVERT_TZ", (at, zone), lambda d, _: F.from_utc_timestamp(d, zone.value))
    known = sorted(zoneinfo.available_timezones())
    return Call(t.DATETIME, True, "CONVERT_TZ", (at, zone), lambda d, z: F.from_utc_timestamp(d, F.when(z.isin(known), z)))


def _now(name: str) -> FunctionSpec:
    make = (lambda: F.current_date().cast("timestamp")) if name == "CURRENT_DATE" else (lambda: F.date_trunc("second", F.current_timestamp()))

    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, 0)
        return Call(t.DATETIME, False, name, (), make)

    return FunctionSpec(name, "today at midnight" if name == "CURRENT_DATE" else "this second, one for the whole query", bind)


SPECS = [
    *(_now(n) for n in ("NOW", "GETDATE", "CURRENT_TIMESTAMP", "CURRENT_DATE")),
    _part_of("EXTRACT"),
    _part_of("DATEPART"),
    *(_short(n) for n in FIELDS),
    FunctionSpec("DATE_TRUNC", "start of a second, minute, hour, day, week (Sunday), month, quarter, year, decade, century, millennium", _truncated),
    FunctionSpec("CONVERT_TZ", "the wall clock of a zone at a UTC time", _to_zone),
]

__all__ = ["SPECS", "simple"]
