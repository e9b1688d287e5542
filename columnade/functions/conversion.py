"""CAST, CONVERT and :: are syntax of their own; the registry lists them, and they can be called with a quoted type."""

from __future__ import annotations

from columnade.functions.spec import BindError, FunctionSpec
from columnade.plans import types as t
from columnade.plans.binder import Binder
from columnade.plans.nodes import Lit, Node


def _to(name: str, type_first: bool) -> FunctionSpec:
    def bind(b: Binder, args: list) -> Node:
        b.want(name, args, 2)
        target, value = args if type_first else reversed(args)
        if not isinstance(target, Lit) or str(target.value).upper() not in t.TARGETS:
            raise BindError(f"{name} wants a type")
        return b.to(value, t.TARGETS[str(target.value).upper()])

    return FunctionSpec(name, "value as another type", bind)


SPECS = [_to("CONVERT", True), _to("CAST", False), _to("::", False)]
