"""Operators over DataFrames."""

from columnade.operators.engine import Compiled, Engine

__all__ = ["Compiled", "Engine"]
