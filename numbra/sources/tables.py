"""File tables with declared schemas, and the sinks that go with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A provided table; Parquet carries its own schema."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> None:
    """Temporary views of provided tables, for SQL text."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = ",", null: str = "", quote: bool = True) -> DataFrame:
    """A CSV table with a declared schema; quote=False takes quote characters as they are."""
    return spark.read.schema(schema).csv(path, sep=delimiter, nullValue=null, quote='"' if quote else "", mode="FAILFAST")


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet table, with a declared schema if there is one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def create_table(spark: SparkSession, name: str, columns: str, path: str, form: str = "parquet", **options: str) -> DataFrame:
    """CREATE TABLE-style declaration: a temporary view of files with declared columns and format options."""
    if form not in ("parquet", "csv"):
        raise ValueError(f"unknown format {form}")
    reader = spark.read.schema(columns).format(form).options(**options)
    frame = reader.load(path)
    frame.createOrReplaceTempView(name)
    return frame


def insert_into(frame: DataFrame, path: str, form: str = "parquet", files: int | None = None, mode: str = "append", **options: str) -> None:
    """INSERT INTO a file table; `files` is the sink's parallelism and so the number of files."""
    out = frame if files is None else frame.repartition(files)
    out.write.mode(mode).format(form).options(**options).save(path)


def blackhole(frame: DataFrame) -> None:
    """Computes every row and keeps none."""
    frame.write.format("noop").mode("overwrite").save()


def convert(spark: SparkSession, source: str, target: str, form: str, files: int, schema: str | None = None, where: str | None = None) -> DataFrame:
    """Rewrites a dataset in another format and number of files, or a part of it; returns the new table."""
    frame = read_csv(spark, source, schema) if form == "parquet" and schema else spark.read.parquet(source)
    frame = frame.filter(where) if where else frame
    insert_into(frame, target, form, files, "overwrite")
    return read_parquet(spark, target) if form == "parquet" else read_csv(spark, target, frame.schema)
