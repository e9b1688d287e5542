"""The unresolved tree against a schema and the registry of functions: a typed tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnade.plans import ast, types as t
from columnade.plans.convert import convert, convert_value
from columnade.plans.errors import Diagnostics
from columnade.plans.nodes import Call, Lit, Logic, Node, Ref

_NOTHING = Lit(t.NULL, True, None)


class BindError(Exception):
    """One finding; the binder notes it and goes on."""


class Binder:
    """``schema`` names the columns; ``columns`` can give some of them as expressions of the host."""

    def __init__(self, schema: T.StructType, functions: dict, diagnostics: Diagnostics, compat: bool = False, columns: dict[str, Column] | None = None):
        self.functions, self.diagnostics, self.compat = functions, diagnostics, compat
        self.fields: dict[str, T.StructField] = {}
        for f in schema.fields:
            self.fields.setdefault(f.name.lower(), f)
        self.own = {k.lower(): c for k, c in (columns or {}).items()}

    def bind(self, tree) -> Node:
        try:
            return self._bind(tree)
        except BindError as e:
            self.diagnostics.errors.append(str(e))
            return _NOTHING

    def _bind(self, tree) -> Node:
        if isinstance(tree, ast.Literal):
            return self._literal(tree)
        if isinstance(tree, ast.Name):
            return self._name(tree)
        if isinstance(tree, ast.Cast):
            value = self.bind(tree.value)
            if tree.target not in t.TARGETS:
                raise BindError(f"unknown type {tree.target}")
            return self.to(value, t.TARGETS[tree.target])
        if tree.name in ("AND", "OR", "NOT"):
            args = tuple(self._truth(self.bind(a), tree.name) for a in tree.args)
            return Logic(t.BOOL, any(a.nullable for a in args), tree.name, args)
        spec = self.functions.get(tree.name)
        if spec is None:
            raise BindError(f"unknown function {tree.name}")
        args = [list(map(self.bind, a.items)) if isinstance(a, ast.Items) else self.bind(a) for a in tree.args]
        return spec.bind(self, args)

    def _truth(self, node: Node, name: str) -> Node:
        if node.type not in (t.BOOL, t.NULL):
            raise BindError(f"{name} wants BOOL, not {node.type}")
        return self.to(node, t.BOOL)

    def _literal(self, tree: ast.Literal) -> Node:
        if tree.kind == "NULL":
            return _NOTHING
        if tree.kind == "TIMESTAMP":
            value = t.parse_datetime(tree.value)
            if value is None:
                raise BindError(f"no timestamp: {tree.value!r}")
            return Lit(t.DATETIME, False, value)
        if tree.kind == "INTERVAL":
            value = t.parse_interval(tree.value)
            if value is None:
                raise BindError(f"no interval: {tree.value!r}")
            return Lit(t.INTERVAL, False, value)
        return Lit(tree.kind, False, tree.value)

    def _name(self, tree: ast.Name) -> Node:
        found = self.fields.get(tree.name.lower())
        if found is None:
            raise BindError(f"unknown column {tree.name}")
        kind = t.of_spark(found.dataType)
        if kind is None:
            raise BindError(f"column {tree.name} has type {found.dataType.simpleString()}, which expressions do not know")
        raw = self.own.get(tree.name.lower(), F.col(f"`{found.name}`"))
        if kind == t.DATETIME and not isinstance(found.dataType, T.TimestampType):
            raw = raw.cast("timestamp")
        if kind == t.DOUBLE and not isinstance(found.dataType, T.DoubleType):
            raw = raw.cast("double")
        return Ref(kind, found.nullable, found.name, raw)

    # what functions use to type their arguments

    def to(self, node: Node, target: str) -> Node:
        if node.type == t.INTERVAL and target == t.DATETIME:
            return node
        try:
            return convert(node, target)
        except KeyError:
            raise BindError(f"cannot convert {node.type} to {target}") from None

    def want(self, name: str, args: list, *counts: int) -> None:
        if len(args) not in counts:
            raise BindError(f"{name} wants {' or '.join(map(str, counts))} arguments, not {len(args)}")

    def common(self, nodes: list[Node]) -> list[Node]:
        """All nodes as one type: equal types stay, numbers become DOUBLE, dates take over the rest, else text."""
        kinds = {n.type for n in nodes} - {t.NULL}
        if len(kinds) <= 1:
            target = next(iter(kinds), t.STRING)
        elif kinds == {t.INT, t.DOUBLE}:
            target = t.DOUBLE
        else:
            target = t.DATETIME if t.DATETIME in kinds else t.STRING
        return [self.to(n, target) for n in nodes]

    def pair(self, a: Node, b: Node) -> tuple[Node, Node]:
        """Two operands as one type; a constant beside a column or function takes that one's type."""
        if a.type == b.type:
            return a, b
        if t.NULL in (a.type, b.type):
            return (self.to(a, b.type), b) if a.type == t.NULL else (a, self.to(b, a.type))
        fixed_a, fixed_b = isinstance(a, Lit), isinstance(b, Lit)
        if fixed_a != fixed_b:
            constant, other = (a, b) if fixed_a else (b, a)
            if (other.type, constant.type) == (t.INT, t.DOUBLE) and not (self.compat or constant.value is None or float(constant.value).is_integer()):
                other = self.to(other, t.DOUBLE)  # cutting the fraction off is only asked for in compat
            made = self.constant(constant, other.type)
            return (made, other) if fixed_a else (other, made)
        return tuple(self.common([a, b]))

    def constant(self, node: Lit, target: str) -> Lit:
        """A constant as ``target``; an error where its text says nothing of that type."""
        try:
            value = convert_value(node.value, node.type, target)
        except KeyError:
            raise BindError(f"cannot convert {node.type} to {target}") from None
        if value is None and node.value is not None and target == t.DATETIME:
            raise BindError(f"no timestamp: {node.value!r}")
        return Lit(target, value is None, value)


def schema_of(df: DataFrame) -> T.StructType:
    return df.schema


__all__ = ["BindError", "Binder", "Call", "schema_of"]
