"""SUM, AVG, MIN, MAX over the arguments of one row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from columnade.functions.spec import BindError, FunctionSpec
from columnade.plans import types as t
from columnade.plans.binder import Binder
from columnade.plans.nodes import Call, Node


def _sum(b: Binder, args: list) -> Node:
    if not args:
        raise BindError("SUM wants arguments")
    typed = tuple(b.to(a, t.DOUBLE) for a in args)
    return Call(t.DOUBLE, False, "SUM", typed, lambda *x: reduce(add, [F.coalesce(c, F.lit(0.0)) for c in x]))


def _avg(b: Binder, args: list) -> Node:
    if not args or any(a.type not in (t.INT, t.DOUBLE, t.NULL) for a in args):
        raise BindError("AVG wants numbers")
    typed = tuple(b.to(a, t.DOUBLE) for a in args)
    return Call(t.DOUBLE, any(a.nullable for a in typed), "AVG", typed, lambda *x: reduce(add, x) / float(len(x)))


def _extreme(name: str) -> FunctionSpec:
    least = name == "MIN"

    def bind(b: Binder, args: list) -> Node:
        if not args:
            raise BindError(f"{name} wants arguments")
        typed = tuple(b.common([b.to(a, t.STRING) if a.type == t.INTERVAL else a for a in args]))
        kind = typed[0].type

        def make(*x: Column) -> Column:
            if kind == t.STRING:  # without regard to case; of equal texts the first
                ranked = F.array(*[F.struct(F.lower(c).alias("key"), F.lit(i if least else -i).alias("place"), c.alias("text")) for i, c in enumerate(x)])
                found = (F.array_min if least else F.array_max)(ranked).text
            elif len(x) == 1:
                found = x[0]
            else:
                found = (F.least if least else F.greatest)(*x)
            unsure = [c for n, c in zip(typed, x, strict=True) if n.nullable]
            if not unsure:
                return found
            return F.when(reduce(lambda p, q: p & q, [c.isNotNull() for c in unsure]), found)

        return Call(kind, any(n.nullable for n in typed), name, typed, make)

    return FunctionSpec(name, f"the {'smallest' if least else 'largest'} argument; NULL if any is", bind)


SPECS = [
    FunctionSpec("SUM", "sum of the arguments, NULLs left out", _sum),
    FunctionSpec("AVG", "mean of the arguments; NULL if any is", _avg),
    _extreme("MIN"),
    _extreme("MAX"),
]
