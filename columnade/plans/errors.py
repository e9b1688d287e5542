"""What can be wrong with an expression."""

from __future__ import annotations

from dataclasses import dataclass, field


class ExpressionError(ValueError):
    """Base of all errors that compiling an expression raises."""


class ParseError(ExpressionError):
    """The text is no expression; ``offset`` says where."""

    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} (at offset {offset})")
        self.offset = offset


class AnalysisError(ExpressionError):
    """The expression does not fit the schema or the functions; ``messages`` has every finding."""

    def __init__(self, messages: list[str]):
        super().__init__("; ".join(messages))
        self.messages = messages


@dataclass
class Diagnostics:
    """Findings of one compilation."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.errors:
            raise AnalysisError(list(self.errors))
