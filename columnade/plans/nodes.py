"""Typed nodes: what the binder makes, and how each becomes a Spark column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from columnade.plans import types as t


@dataclass(frozen=True)
class Node:
    """``type`` of the value, and whether it can be NULL."""

    type: str
    nullable: bool = True

    def column(self, filtering: bool = False) -> Column:
        """The Spark column; ``filtering``: NULL and FALSE mean the same where it stands."""
        raise NotImplementedError

    def children(self) -> tuple[Node, ...]:
        return ()

    def title(self) -> str:
        return type(self).__name__


@dataclass(frozen=True)
class Lit(Node):
    """A constant: int, float, str, bool, seconds since 1970 (DATETIME), an Interval, or None."""

    value: Any = None

    def column(self, filtering: bool = False) -> Column:
        if self.value is None:
            kind = {t.INT: "int", t.DOUBLE: "double", t.STRING: "string", t.DATETIME: "timestamp", t.BOOL: "boolean"}.get(self.type, "string")
            return F.lit(None).cast(kind)
        if self.type == t.DATETIME:
            return F.timestamp_seconds(F.lit(self.value))
        if self.type == t.INTERVAL:
            return F.lit(self.value.text)
        return F.lit(float(self.value) if self.type == t.DOUBLE else self.value)

    def title(self) -> str:
        return f"{self.type} {self.value!r}"


@dataclass(frozen=True)
class Ref(Node):
    """A column. A DATETIME's ``raw`` is a timestamp that still has its fraction of a second."""

    name: str = ""
    raw: Column | None = field(default=None, compare=False)

    def column(self, filtering: bool = False) -> Column:
        return F.date_trunc("second", self.raw) if self.type == t.DATETIME else self.raw

    def title(self) -> str:
        return f"{self.name}: {self.type}"


@dataclass(frozen=True)
class Call(Node):
    """A function on arguments; ``make`` gets their columns."""

    name: str = ""
    args: tuple[Node, ...] = ()
    make: Callable[..., Column] = field(default=None, compare=False)

    def column(self, filtering: bool = False) -> Column:
        return self.make(*[a.column() for a in self.args])

    def children(self) -> tuple[Node, ...]:
        return self.args

    def title(self) -> str:
        return f"{self.name}: {self.type}"


@dataclass(frozen=True)
class Logic(Node):
    """AND, OR, NOT. AND and OR are NULL when either side is, even beside a deciding side."""

    name: str = ""
    args: tuple[Node, ...] = ()

    def column(self, filtering: bool = False) -> Column:
        if self.name == "NOT":
            return ~self.args[0].column()
        left, right = self.args
        if self.name == "AND" and filtering:
            return left.column(True) & right.column(True)
        a, b = left.column(), right.column()
        both = a & b if self.name == "AND" else a | b
        unsure = [c for n, c in ((left, a), (right, b)) if n.nullable]
        if not unsure:
            return both
        if filtering:  # conjuncts, which reach the scan
            for c in unsure:
                both = both & c.isNotNull()
            return both
        null = unsure[0].isNull()
        for c in unsure[1:]:
            null = null | c.isNull()
        return F.when(~null, both)

    def children(self) -> tuple[Node, ...]:
        return self.args

    def title(self) -> str:
        return self.name


def show(node: Node, depth: int = 0) -> str:
    """An indented picture of a tree."""
    return "\n".join(["  " * depth + node.title(), *(show(c, depth + 1) for c in node.children())])
