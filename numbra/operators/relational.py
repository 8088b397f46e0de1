"""The relational shapes as DataFrame compositions; Catalyst picks their physical form."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numbra.session import cut


def calc(frame: DataFrame, columns: dict[str, Column | str], where: Column | str | None = None) -> DataFrame:
    """Projection over at most one filter; rows whose condition is unknown are not selected."""
    rows = frame if where is None else frame.filter(where)
    return rows.select(*((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def grouped_sum(frame: DataFrame, key: Column | str, value: Column | str, name: str = "total") -> DataFrame:
    """SUM(value) by one key, computed or not; partial sums are made before the shuffle. A null key is a group of
    its own, null values count as nothing, a group of nulls sums to null, an empty table has no groups."""
    k, v = (F.expr(x) if isinstance(x, str) else x for x in (key, value))
    return frame.groupBy(k.alias("k")).agg(F.sum(v).alias(name))


def project_sum(frame: DataFrame, value: Column | str, name: str = "total") -> DataFrame:
    """SUM of an expression over all rows; null for no rows."""
    return frame.agg(F.sum(F.expr(value) if isinstance(value, str) else value).alias(name))


def sort_rows(frame: DataFrame, key: str, *ties: str, limit: int | None = None) -> DataFrame:
    """All rows by a key, or the first `limit`; ties name the columns that stand for a stable order. Nulls come
    first, NaN last; repeated rows stay; an empty table stays empty."""
    ordered = frame.orderBy(key, *ties)
    return ordered if limit is None else ordered.limit(limit)


def equi_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, hint: str | None = None) -> DataFrame:
    """Inner join on one key: nulls match nothing and repeated keys fan out."""
    side = build.hint(hint) if hint else build
    return probe.join(side, probe[probe_key] == build[build_key], "inner")


def multi_regex_count(frame: DataFrame, column: str, patterns: list[str] | tuple[str, ...], name: str = "matches") -> DataFrame:
    """COUNT of rows whose text holds every pattern somewhere. A null text holds none; an empty one those that
    match nothing at all; an empty table counts 0."""
    if not patterns:
        raise ValueError("at least one pattern is needed")
    return frame.filter(reduce(lambda a, b: a & b, (F.col(column).rlike(p) for p in patterns))).agg(F.count("*").alias(name))


def _carry(order: str, value: str, offsets: dict[int, tuple]):
    """Rows come by range, in order; adds the running sum within the range to what the ranges before it have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, begun = None, False, False
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(value)
            column = batch.column(at)
            if not begun:
                begun = True
                total, seen = offsets.get(batch.column(batch.schema.get_field_index(order))[0].as_py(), (None, False))
            if pa.types.is_decimal(column.type):
                out = []
                for x in column.to_pylist():
                    total, seen = (total or 0) + (x or 0), seen or x is not None
                    out.append(total if seen else None)
                sums = pa.array(out, column.type)
            else:
                there = pc.is_valid(column).to_numpy(zero_copy_only=False)
                steps = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).copy()
                steps[0] += total or 0
                found = np.cumsum(steps)
                some = np.logical_or.accumulate(there) | seen
                sums = pa.array(found, column.type, mask=~some)
                total, seen = found[-1].item(), bool(some[-1])
            names = [n for n in batch.schema.names if n not in (order, value)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), sums], [*names, value])

    return run


def running_total(frame: DataFrame, value: str, *order: str, name: str = "running") -> DataFrame:
    """Adds SUM(value) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING) without moving all rows to one task.

    Rows are range-partitioned and sorted by the order once, and cut there, so that a range is the same in each
    pass; each range is summed, one number for each comes to the driver, and each range is walked from the sum of
    those before it. Null values count as nothing, as in SUM, and rows before the first value get null; null
    order keys come first; an order with ties is refined by no hidden column, so `order` should be unique; an
    empty table stays empty. Integers add as long, others as double or decimal. No column may be called _range
    or _value; `name` must be new.
    """
    if clash := {"_range", "_value", name} & set(frame.columns):
        raise ValueError(f"columns are called {clash}")
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = frame.select(F.sum(value).alias("x")).schema["x"].dataType.simpleString()
    rows = frame.withColumn("_value", F.col(value).cast(kind))
    rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("_range", F.spark_partition_id())
    offsets, total, seen = {}, None, False
    for r in sorted(rows.groupBy("_range").agg(F.sum("_value").alias("x")).collect(), key=lambda r: r["_range"]):  # a row for each range
        offsets[r["_range"]] = (total, seen)
        if r["x"] is not None:
            total, seen = r["x"] if total is None else total + r["x"], True
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return rows.mapInArrow(_carry("_range", "_value", offsets), f"{shape}, _value {kind}").withColumnRenamed("_value", name)
