"""The registry of functions and operators."""

from __future__ import annotations

from columnade.functions.spec import FunctionSpec


def builtin() -> dict[str, FunctionSpec]:
    """All built-in functions by name."""
    from columnade.functions import arithmetic, conversion, datetimes, predicates, rowwise, strings

    return {s.name: s for m in (predicates, arithmetic, conversion, strings, datetimes, rowwise) for s in m.SPECS}


__all__ = ["FunctionSpec", "builtin"]
