"""The unresolved tree that the parser makes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Literal:
    """kind: INT, DOUBLE, STRING, BOOL, TIMESTAMP, INTERVAL or NULL."""

    kind: str
    value: Any


@dataclass(frozen=True)
class Name:
    name: str
    offset: int


@dataclass(frozen=True)
class Apply:
    """A function or operator on arguments."""

    name: str
    args: tuple
    offset: int


@dataclass(frozen=True)
class Items:
    """The list on the right of IN."""

    items: tuple


@dataclass(frozen=True)
class Cast:
    value: Any
    target: str
    offset: int


def show(node, depth: int = 0) -> str:
    """An indented picture of a tree."""
    pad = "  " * depth
    if isinstance(node, Apply):
        return "\n".join([f"{pad}{node.name}", *(show(a, depth + 1) for a in node.args)])
    if isinstance(node, Items):
        return "\n".join([f"{pad}LIST", *(show(a, depth + 1) for a in node.items)])
    if isinstance(node, Cast):
        return f"{pad}CAST AS {node.target}\n{show(node.value, depth + 1)}"
    if isinstance(node, Name):
        return f"{pad}{node.name}"
    return f"{pad}{node.kind} {node.value!r}"
