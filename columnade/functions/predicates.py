"""Comparisons, BETWEEN, IN, LIKE and the IS family.

Texts compare without regard to case; equality with a short constant becomes
a list of its spellings, so that it reaches the scan. A bare DATETIME column beside a whole
second becomes a range on the untruncated column, so that it reaches the scan.
"""

from __future__ import annotations

import itertools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from columnade.functions.spec import BindError, FunctionSpec
from columnade.plans import types as t
from columnade.plans.binder import Binder
from columnade.plans.nodes import Call, Lit, Node, Ref

_OPERATORS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_ORDERED = (t.BOOL, t.INT, t.DOUBLE, t.STRING, t.DATETIME)


def folded(node: Node) -> Column:
    """A text as it compares: lower case, done here for constants."""
    if node.type != t.STRING:
        return node.column()
    return F.lit(node.value.lower()) if isinstance(node, Lit) and node.value is not None else F.lower(node.column())


def spellings(text: str, most: int = 16) -> list[str] | None:
    """All texts whose lower case is that of a short ASCII text; None where there are more than ``most``, or another character."""
    if not text.isascii():
        return None
    choices = [sorted({c.lower(), c.upper(), *("\u212a" if c in "kK" else "")}) for c in text]  # the Kelvin sign's lower case is k
    if math.prod(map(len, choices)) > most:
        return None
    return ["".join(c) for c in itertools.product(*choices)]


def _one_of(value: Node, items: list[Node]) -> Column | None:
    """A text column against short constants as a list of spellings, which reaches the scan; None where that cannot be."""
    if not isinstance(value, Ref) or value.type != t.STRING or not all(isinstance(n, Lit) and n.value is not None for n in items):
        return None
    found = [spellings(n.value) for n in items]
    if None in found or sum(map(len, found)) > 64:
        return None
    return value.column().isin(*itertools.chain.from_iterable(found))


def _second(n: int) -> Column:
    return F.timestamp_seconds(F.lit(n))


def _on_range(op: str, raw: Column, at: int) -> Column:
    """``date_trunc('second', raw) op at`` without the truncation."""
    if op == "<":
        return raw < _second(at)
    if op == "<=":
        return raw < _second(at + 1)
    if op == ">":
        return raw >= _second(at + 1)
    if op == ">=":
        return raw >= _second(at)
    inside = (raw >= _second(at)) & (raw < _second(at + 1))
    return inside if op == "=" else ~inside


def _comparison(op: str) -> FunctionSpec:
    def bind(b: Binder, args: list) -> Node:
        b.want(op, args, 2)
        left, right = args
        if t.INTERVAL in (left.type, right.type):
            left, right = (b.to(a, t.STRING) if a.type == t.INTERVAL else a for a in args)
        left, right = b.pair(left, right)
        if left.type == t.NULL:
            return Lit(t.BOOL, True, None)
        if left.type not in _ORDERED or right.type not in _ORDERED:
            raise BindError(f"{op} cannot compare {left.type} and {right.type}")

        def make(x: Column, y: Column) -> Column:
            for a, c, name in ((left, right, op), (right, left, _FLIPPED.get(op, op))):
                if isinstance(a, Ref) and a.type == t.DATETIME and isinstance(c, Lit) and c.value is not None:
                    return _on_range(name, a.raw, c.value)
            if op in ("=", "!="):
                for a, c in ((left, right), (right, left)):
                    if (same := _one_of(a, [c])) is not None:
                        return same if op == "=" else ~same
            return _OPERATORS[op](folded(left), folded(right)) if left.type == t.STRING else _OPERATORS[op](x, y)

        return Call(t.BOOL, left.nullable or right.nullable, op, (left, right), make)

    return FunctionSpec(op, f"{op} of two values of one type; NULL if either is", bind)


def _between(negated: bool) -> FunctionSpec:
    name = "NOT BETWEEN" if negated else "BETWEEN"

    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, 3)
        value, low, high = b.common([b.to(a, t.STRING) if a.type == t.INTERVAL else a for a in args])
        if value.type == t.BOOL:
            raise BindError(f"{name} does not order BOOL")

        def make(x: Column, y: Column, z: Column) -> Column:
            fixed = all(isinstance(n, Lit) and n.value is not None for n in (low, high))
            if isinstance(value, Ref) and value.type == t.DATETIME and fixed:
                inside = _on_range(">=", value.raw, low.value) & _on_range("<=", value.raw, high.value)
                return ~inside if negated else inside
            if value.type == t.STRING:
                x, y, z = folded(value), folded(low), folded(high)
            inside = x.between(y, z)
            nullable = [c for n, c in ((value, x), (low, y), (high, z)) if n.nullable]
            if not nullable or not low.nullable and not high.nullable:
                return ~inside if negated else inside
            known = nullable[0].isNotNull()
            for c in nullable[1:]:
                known = known & c.isNotNull()
            return F.when(known, ~inside if negated else inside)

        return Call(t.BOOL, any(n.nullable for n in (value, low, high)), name, (value, low, high), make)

    return FunctionSpec(name, f"value {name} low AND high, of one type; NULL if any is", bind)


def _in(negated: bool) -> FunctionSpec:
    name = "NOT IN" if negated else "IN"

    def bind(b: Binder, args: list) -> Node:
        value, items = args
        kinds = {n.type for n in items} - {t.NULL}
        if value.type in (t.INT, t.DOUBLE) and kinds <= {t.INT, t.DOUBLE}:
            target = t.DOUBLE if {value.type, *kinds} == {t.INT, t.DOUBLE} else value.type
        else:
            target = value.type if value.type not in (t.NULL, t.INTERVAL) else next(iter(kinds), t.STRING)
        value = b.to(value, target)
        items = [b.constant(n, target) if isinstance(n, Lit) else b.to(n, target) for n in items]

        def make(*_: Column) -> Column:
            found = _one_of(value, items)
            if found is None:
                found = folded(value).isin(*[folded(n) for n in items])
            return F.coalesce(~found, F.lit(True)) if negated else found

        return Call(t.BOOL, not negated and (value.nullable or any(n.nullable for n in items)), name, (value, *items), make)

    return FunctionSpec(name, "value NOT IN (...): TRUE unless it is found, for NULL too" if negated else "value IN (...)", bind)


def _like(negated: bool) -> FunctionSpec:
    name = "NOT LIKE" if negated else "LIKE"

    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, 2)
        value, pattern = (b.to(a, t.STRING) for a in args)

        def make(x: Column, y: Column) -> Column:
            if isinstance(pattern, Lit) and pattern.value is not None:
                text = pattern.value.replace("\\", "\\\\").replace(" ", "%")
                found = x.ilike(text)
            else:
                found = F.ilike(x, F.replace(F.replace(y, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("%")))
            return ~found if negated else found

        return Call(t.BOOL, value.nullable or pattern.nullable, name, (value, pattern), make)

    return FunctionSpec(name, "text LIKE pattern, without regard to case; % and a space stand for any text, _ for one character", bind)


def _is(what: str, negated: bool) -> FunctionSpec:
    name = f"IS NOT {what}" if negated else f"IS {what}"

    def bind(b: Binder, args: list) -> Node:
        (value,) = args
        if what == "NULL":
            make = (lambda x: x.isNotNull()) if negated else (lambda x: x.isNull())
        else:
            if value.type not in (t.BOOL, t.NULL):
                raise BindError(f"{name} wants BOOL, not {value.type}")
            value = b.to(value, t.BOOL)
            truth = (lambda x: F.coalesce(x, F.lit(False))) if what == "TRUE" else (lambda x: F.coalesce(~x, F.lit(False)))
            make = (lambda x: ~truth(x)) if negated else truth
        return Call(t.BOOL, False, name, (value,), make)

    return FunctionSpec(name, f"value {name}; never NULL", bind)


SPECS = [
    *(_comparison(op) for op in _OPERATORS),
    *(_between(n) for n in (False, True)),
    *(_in(n) for n in (False, True)),
    *(_like(n) for n in (False, True)),
    *(_is(what, n) for what in ("NULL", "TRUE", "FALSE") for n in (False, True)),
]
