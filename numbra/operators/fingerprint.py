"""Checks on whole tables that do not depend on order or layout."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint(frame: DataFrame) -> DataFrame:
    """rows, and sum (integers), min and max of each column that has an order."""
    out = [F.count("*").alias("rows")]
    for f in frame.schema:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.append(F.sum(f.name).cast("long").alias(f"{f.name}_sum"))
        if isinstance(f.dataType, (T.NumericType, T.StringType, T.TimestampType, T.DateType)):
            out += [F.min(f.name).alias(f"{f.name}_min"), F.max(f.name).alias(f"{f.name}_max")]
    return frame.agg(*out)


def canonical_rows(frame: DataFrame) -> list[tuple[str, ...]]:
    """All rows of a small result as sorted tuples of texts: doubles by their bits, one NaN."""

    def text(x: object) -> str:
        if isinstance(x, float):
            return "nan" if math.isnan(x) else struct.pack(">d", x).hex()
        return repr(x)

    return sorted(tuple(text(x) for x in r) for r in frame.collect())


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with the side they are on, repeats included."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
