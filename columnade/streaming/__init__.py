"""Expressions on streams: every compiled expression is a stateless column, so batch and stream share the engine."""

from columnade.streaming.filters import filter_stream

__all__ = ["filter_stream"]
