"""Texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from columnade.functions.spec import BindError, FunctionSpec, simple
from columnade.plans import types as t
from columnade.plans.binder import Binder
from columnade.plans.nodes import Call, Lit, Node


def _concat(b: Binder, args: list) -> Node:
    if not args:
        raise BindError("CONCAT wants arguments")
    texts = tuple(b.to(a, t.STRING) for a in args)
    return Call(t.STRING, True, "CONCAT", texts, lambda *x: F.nullif(F.concat_ws("", *x), F.lit("")))


def _substr(name: str) -> FunctionSpec:
    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, 2, 3)
        typed = (b.to(args[0], t.STRING), *(b.to(a, t.INT) for a in args[1:]))

        def make(x: Column, start: Column, length: Column | None = None) -> Column:
            ok = (start >= 1) & (start <= F.length(x))
            if length is None:
                return F.when(ok, F.substring(x, start, F.length(x)))
            return F.when(ok & (length >= 0), F.substring(x, start, length))

        return Call(t.STRING, True, name, typed, make)

    return FunctionSpec(name, "part of a text from a place (the first is 1), of a length; NULL where the place lies outside", bind)


def _coalesce(b: Binder, args: list) -> Node:
    if not args:
        raise BindError("COALESCE wants arguments")
    kinds = {a.type for a in args} - {t.NULL}
    if len(kinds) > 1 and kinds != {t.INT, t.DOUBLE}:
        raise BindError(f"COALESCE wants one type, not {', '.join(sorted(kinds))}")
    typed = tuple(b.common(args))
    return Call(typed[0].type, all(a.nullable for a in typed), "COALESCE", typed, F.coalesce)


def _case(name: str, make) -> FunctionSpec:
    spec = simple(name, {"LOWER": "lower case", "UPPER": "upper case"}[name], (t.STRING,), t.STRING, make)

    def bind(b: Binder, args: list) -> Node:
        made = spec.bind(b, args)
        (value,) = made.args
        return Lit(t.STRING, value.value is None, value.value and getattr(value.value, name.lower())()) if isinstance(value, Lit) else made

    return FunctionSpec(name, spec.description, bind)


SPECS = [
    FunctionSpec("CONCAT", "texts joined, NULLs left out; NULL where nothing is left", _concat),
    simple("LENGTH", "bytes of a text", (t.STRING,), t.INT, F.octet_length),
    _case("LOWER", F.lower),
    _case("UPPER", F.upper),
    _substr("SUBSTR"),
    _substr("SUBSTRING"),
    simple("TRIM", "without spaces at both ends", (t.STRING,), t.STRING, F.trim),
    simple("LTRIM", "without leading spaces", (t.STRING,), t.STRING, F.ltrim),
    simple("RTRIM", "without trailing spaces", (t.STRING,), t.STRING, F.rtrim),
    FunctionSpec("COALESCE", "the first value that is not NULL", _coalesce),
]
