"""What a function is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from columnade.plans import types as t
from columnade.plans.binder import Binder, BindError
from columnade.plans.nodes import Call, Node


@dataclass(frozen=True)
class FunctionSpec:
    """``bind(binder, args)`` checks and converts the arguments and says what the call is worth.

    It raises :class:`BindError` where the arguments do not fit.
    """

    name: str
    description: str
    bind: Callable[[Binder, list], Node]


def simple(name: str, description: str, takes: tuple[str, ...], gives: str, make: Callable[..., Column], null_in_null_out: bool = True) -> FunctionSpec:
    """A function of fixed argument types, made of built-in expressions."""

    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, len(takes))
        typed = tuple(b.to(a, kind) for a, kind in zip(args, takes, strict=True))
        return Call(gives, not null_in_null_out or any(a.nullable for a in typed), name, typed, make)

    return FunctionSpec(name, description, bind)


def user_function(name: str, takes: tuple[str, ...], gives: str, make: Callable[..., Column], description: str = "") -> FunctionSpec:
    """A host's function over columns, a ``pandas_udf`` among others."""
    known = {t.INT, t.DOUBLE, t.STRING, t.DATETIME, t.BOOL}
    if not {*takes, gives} <= known:
        raise ValueError(f"types of {name} must be among {sorted(known)}")
    return simple(name.upper(), description, takes, gives, make, null_in_null_out=False)


__all__ = ["BindError", "FunctionSpec", "simple", "user_function"]
