"""Calc and regular-expression filters over Structured Streaming: they are plain columns, so they run as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numbra.operators.relational import calc


def stream_table(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_calc(stream: DataFrame, columns: dict[str, str], where: str | None = None) -> DataFrame:
    return calc(stream, columns, where)


def stream_matches(stream: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose text holds every pattern."""
    return stream.filter(reduce(lambda a, b: a & b, (F.col(column).rlike(p) for p in patterns)))


def windowed_sum(stream: DataFrame, time: str, key: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """SUM and COUNT by key and tumbling window; rows later than the watermark are left out, and its state goes."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width), key)
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("window.start", "window.end", key, "n", "total")
