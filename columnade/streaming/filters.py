"""Filtering streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from columnade.operators import Engine


def filter_stream(spark: SparkSession, folder: str, like: DataFrame, text: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of the parquet files of ``folder`` (schema of ``like``), filtered by an expression."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return Engine(spark).filter(reader.parquet(folder), text)
