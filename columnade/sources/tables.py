"""Sources and sinks: JSON documents with a typed table, row files with a table definition, parquet."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from columnade.plans import types as t

_SPARK = {"INT": T.LongType(), "DOUBLE": T.DoubleType(), "DATETIME": T.TimestampType(), "BOOL": T.BooleanType()}
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _value(value, kind: str):
    """A JSON value as its column's type; JSON null, a missing key, an empty text and the epoch itself are NULL."""
    if value is None or value == "":
        return None
    if kind == "INT":
        return int(float(value))
    if kind == "DOUBLE":
        return float(value)
    if kind == "BOOL":
        return value if isinstance(value, bool) else str(value).lower() in ("true", "1")
    if kind == "DATETIME":
        if isinstance(value, str) and ("-" in value or len(value) == 4):
            seconds = t.parse_datetime(value)
        else:
            seconds = int(float(value)) or None
        return None if seconds is None else _EPOCH + datetime.timedelta(seconds=seconds)
    return value if isinstance(value, str) else json.dumps(value)


def json_table(spark: SparkSession, columns: list[dict], rows: list[dict]) -> DataFrame:
    """A DataFrame from column definitions (name, type; unknown types are texts) and JSON objects."""
    kinds = [(c["name"], c.get("type", "STRING") if c.get("type") in _SPARK else "STRING") for c in columns]
    schema = T.StructType([T.StructField(n, _SPARK.get(k, T.StringType())) for n, k in kinds])
    return spark.createDataFrame([tuple(_value(r.get(n), k) for n, k in kinds) for r in rows], schema)


def json_document(spark: SparkSession, path: str | Path) -> tuple[DataFrame, list[dict]]:
    """The table of a document ``{"table": {...}, "queries": [...]}``, and its queries."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return json_table(spark, found["table"]["columns"], found["table"]["rows"]), found.get("queries", [])


def json_documents(spark: SparkSession, folder: str | Path) -> Iterator[tuple[Path, DataFrame, list[dict]]]:
    """All documents below a folder."""
    for path in sorted(Path(folder).rglob("*.json")):
        yield path, *json_document(spark, path)


def json_rows(spark: SparkSession, definition: str, rows: str) -> DataFrame:
    """Two files: a table definition, and JSON objects (one a line, or one list) that Spark reads by that schema.

    Objects that stand one a line are read by many tasks; a list is one task's.
    """
    columns = json.loads(Path(definition).read_text(encoding="utf-8"))["columns"]
    schema = T.StructType([T.StructField(c["name"], _SPARK.get(c.get("type"), T.StringType())) for c in columns])
    first = spark.read.text(rows).where("trim(value) <> ''").first()
    listed = first is not None and first.value.lstrip("\ufeff \t").startswith("[")
    return spark.read.schema(schema).option("multiLine", listed).json(rows)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_ids(df: DataFrame, path: str, column: str = "id") -> None:
    """The sink of a filter: the ids that matched, as text files."""
    df.select(df[column].cast("string")).write.mode("overwrite").text(path)
