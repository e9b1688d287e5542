"""Filter and project DataFrames by expressions in text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from columnade.functions import FunctionSpec, builtin
from columnade.plans import ast, nodes
from columnade.plans import types as t
from columnade.plans.binder import Binder
from columnade.plans.errors import AnalysisError, Diagnostics
from columnade.plans.fold import fold
from columnade.plans.lexer import tokenize
from columnade.plans.parser import parse


@dataclass(frozen=True)
class Compiled:
    """An expression that has been typed against a schema."""

    text: str
    tree: object
    bound: nodes.Node
    folded: nodes.Node

    @property
    def type(self) -> str:
        return self.folded.type

    @property
    def constant(self) -> bool:
        return isinstance(self.folded, nodes.Lit)

    def column(self) -> Column:
        """The value."""
        return self.folded.column()

    def predicate(self) -> Column:
        """The condition of a filter: NULL counts as FALSE, which lets conjuncts reach the scan."""
        if self.type not in (t.BOOL, t.NULL):
            raise AnalysisError([f"a filter wants BOOL, not {self.type}"])
        return self.folded.column(filtering=True)


class Engine:
    """Compiles expressions to native Spark columns, for batch and streaming DataFrames alike.

    ``compat``: cut the fraction off a constant beside an INT column, and count
    millennia from 1900. The session time zone becomes UTC, in which all dates
    are meant.
    """

    def __init__(self, spark: SparkSession, compat: bool = False):
        self.spark, self.compat = spark, compat
        self._functions: dict[str, FunctionSpec] = builtin()
        self._reserved: set[str] = set()
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def register(self, spec: FunctionSpec) -> None:
        """Add a function, or put one in the place of a built-in."""
        self._functions[spec.name.upper()] = spec

    def reserve(self, word: str) -> None:
        """Make a word a keyword, which no column can be called by."""
        self._reserved.add(word.upper())

    def functions(self) -> dict[str, str]:
        """Names and descriptions of all functions and operators."""
        own = {"AND": "both; NULL if either is", "OR": "either; NULL if either is", "NOT": "the contrary", "==": "as ="}
        return dict(sorted({**own, **{n: s.description for n, s in self._functions.items()}}.items()))

    def compile(self, text: str, schema: T.StructType, columns: dict[str, Column] | None = None) -> Compiled:
        """Parse, type and fold; raises ParseError, or AnalysisError with all findings."""
        tree = parse(text, self._reserved, {f.name for f in schema.fields})
        found = Diagnostics()
        bound = Binder(schema, self._functions, found, self.compat, columns).bind(tree)
        found.check()
        return Compiled(text, tree, bound, fold(bound))

    def filter(self, df: DataFrame, text: str | None, columns: dict[str, Column] | None = None) -> DataFrame:
        """Rows for which the expression is TRUE; without an expression all rows."""
        if text is None or not text.strip():
            return df
        return df.filter(self.compile(text, df.schema, columns).predicate())

    def project(self, df: DataFrame, expressions: dict[str, str], keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """The columns ``keep`` and a new column for each name and expression."""
        made = [self.compile(text, df.schema).column().alias(name) for name, text in expressions.items()]
        return df.select(*keep, *made)

    def with_column(self, df: DataFrame, name: str, text: str) -> DataFrame:
        return df.withColumn(name, self.compile(text, df.schema).column())

    def value(self, text: str):
        """The value of an expression without columns; no job runs where folding gives it."""
        done = self.compile(text, T.StructType([]))
        if done.constant and done.type not in (t.DATETIME, t.INTERVAL):
            return done.folded.value
        return self.spark.range(1).select(done.column().alias("value")).first()["value"]

    def explain(self, text: str, schema: T.StructType) -> str:
        """Tokens, tree, typed tree and folded tree of an expression, as text."""
        done = self.compile(text, schema)
        tokens = " ".join(f"{k.kind}:{k.text}" for k in tokenize(text) if k.kind != "end")
        return "\n".join(["== Tokens ==", tokens, "== Tree ==", ast.show(done.tree), "== Bound ==", nodes.show(done.bound), "== Folded ==", nodes.show(done.folded)])
