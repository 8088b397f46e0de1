"""Seeded bounded generators: the same rows in every run, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier of the shuffle id * m mod n, which is a permutation for any n it has no divisor in common with.
SHUFFLE = 2654435761


def uniform(key: Column, low: float, high: float, salt: int) -> Column:
    """A double in [low, high) that depends on key and salt alone."""
    share = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return F.lit(low) + share * (high - low)


def sequence_table(spark: SparkSession, rows: int, start: int = 0, **fields: tuple[float, float]) -> DataFrame:
    """id (from start) and doubles with given bounds, as a bounded generator table."""
    base = spark.range(start, start + rows)
    return base.select("id", *(uniform(F.col("id"), low, high, k).alias(name) for k, (name, (low, high)) in enumerate(fields.items())))


def permuted(key: Column, rows: int) -> Column:
    """A permutation of 0..rows-1 (for rows without a common divisor with SHUFFLE)."""
    return F.pmod(key * F.lit(SHUFFLE), F.lit(rows))


def points(spark: SparkSession, rows: int) -> DataFrame:
    return sequence_table(spark, rows, lat=(-90.0, 90.0), lon=(-180.0, 180.0))


def measurements(spark: SparkSession, rows: int) -> DataFrame:
    """Both columns are sequences."""
    return spark.range(rows).select("id", F.col("id").cast("double").alias("val"))


def keyed_events(spark: SparkSession, rows: int) -> DataFrame:
    base = spark.range(rows)
    return base.select(permuted(F.col("id"), rows).cast("int").alias("k"), F.col("id").alias("seq"), uniform(F.col("id"), 0.0, 1000.0, 1).alias("val"))


def signals(spark: SparkSession, rows: int) -> DataFrame:
    made = sequence_table(spark, rows, a=(0.0, 10.0), b=(0.0, 10.0), c=(0.0, 10.0))
    return made.select(F.floor(uniform(F.col("id"), 0.0, 1e6, 9)).cast("int").alias("bucket"), "a", "b", "c")


def readings(spark: SparkSession, rows: int, machines: int = 48) -> DataFrame:
    made = sequence_table(spark, rows, phase=(0.0, 86400.0), temp=(5.0, 45.0), vibration=(0.0, 1.6), pressure=(95.0, 108.0), amps=(2.5, 6.0))
    return made.select(F.pmod("id", F.lit(machines)).cast("int").alias("machine_id"), F.col("id").alias("sensor_id"), "phase", "temp", "vibration", "pressure", "amps")


def vectors(spark: SparkSession, rows: int, width: int, low: float = 0.0, high: float = 1.0, prefix: str = "v") -> DataFrame:
    return sequence_table(spark, rows, **{f"{prefix}{i}": (low, high) for i in range(width)})


def option_book(spark: SparkSession, rows: int) -> DataFrame:
    return sequence_table(spark, rows, spot=(20.0, 400.0), strike=(20.0, 400.0), tau=(0.05, 3.0), vol=(0.08, 0.75))


def conformance(spark: SparkSession, rows: int) -> DataFrame:
    """Doubles that decide bits: products that cancel, zeros, huge and tiny values, nulls in every third row."""
    made = sequence_table(spark, rows, a=(-1e3, 1e3), b=(-1e3, 1e3))
    third = F.pmod("id", F.lit(3)) == 0
    return made.select(
        "id", "a", "b", (-(F.col("a") * F.col("b"))).alias("c"), F.lit(0.0).alias("z"), F.lit(-1.5).alias("neg"), F.lit(1.5e308).alias("big"),
        F.lit(5e-324).alias("tiny"), F.col("a").cast("float").alias("f"), F.when(~third, F.col("b")).alias("n"),
    )
