"""Iterative fits: each pass is one distributed aggregate over rows that stay cached.

Narrow shapes are SQL expressions; wide ones go through NumPy blocks, one row of partial sums for each cluster
(or one in all) and task. Columns are doubles without nulls; labels too.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.functions import exprs as E
from numbra.plans.strategy import choose

#: Rows that a block holds against all centroids at once.
TILE = 1024


def spread_centroids(clusters: int, dims: int, spread: float = 3.0, seed: int = 42) -> list[list[float]]:
    """The same start in every run, uniform in plus and minus `spread`."""
    r = random.Random(seed)
    return [[(r.random() * 2 - 1) * spread for _ in range(dims)] for _ in range(clusters)]


def distances(columns: list[str], centroids: list[list[float]]) -> list[str]:
    return [E.squared_distance(columns, c) for c in centroids]


def argmin(columns: list[str], centroids: list[list[float]]) -> str:
    """Number of the nearest centroid; the first wins ties."""
    found = f"array({', '.join(distances(columns, centroids))})"
    return f"CAST(array_position({found}, array_min({found})) - 1 AS INT)"


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, number of the nearest centroid, its squared distance) by tiles; the first wins ties."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
    for i in range(0, len(x), TILE):
        part = x[i : i + TILE]
        d = np.empty((len(part), len(centroids)))
        for k, c in enumerate(centroids):
            d[:, k] = ((part - c) ** 2).sum(axis=1)
        at = d.argmin(axis=1)
        yield part, at, d[np.arange(len(part)), at]


def _cluster_sums(centroids: list[list[float]]) -> Callable:
    """Rows (cid, members, total, s0, s1, ...) of a task's clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids)
        members, total, sums = np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(c.shape)
        for batch in batches:
            if batch.num_rows:
                for part, at, near in _nearest(batch, c):
                    members += np.bincount(at, minlength=len(c))
                    total += np.bincount(at, near, len(c))
                    np.add.at(sums, at, part)
        some = np.flatnonzero(members)
        columns = [pa.array(some.astype(np.int32)), pa.array(members[some]), pa.array(total[some]), *(pa.array(sums[some, i]) for i in range(c.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, ["cid", "members", "total", *(f"s{i}" for i in range(c.shape[1]))])

    return run


def _by_blocks(frame: DataFrame, columns: list[str], centroids: list[list[float]]) -> DataFrame:
    shape = ", ".join(["cid int, members long, total double", *(f"s{i} double" for i in range(len(columns)))])
    return frame.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(_cluster_sums(centroids), shape)


def kmeans_assign(frame: DataFrame, columns: list[str], centroids: list[list[float]], strategy: str | None = None) -> DataFrame:
    """COUNT of points and SUM of squared distances to the nearest centroid (null for no points)."""
    if choose(frame.sparkSession, "kmeans", len(columns) * len(centroids), strategy) == "blas":
        return _by_blocks(frame, columns, centroids).agg(F.coalesce(F.sum("members"), F.lit(0)).alias("points"), F.sum("total").alias("total"))
    return frame.select(F.expr(E.least(distances(columns, centroids))).alias("nearest")).agg(F.count("*").alias("points"), F.sum("nearest").alias("total"))


def kmeans_iterate(frame: DataFrame, columns: list[str], centroids: list[list[float]], strategy: str | None = None) -> DataFrame:
    """Members and coordinate sums of each cluster that has any."""
    if choose(frame.sparkSession, "kmeans", len(columns) * len(centroids), strategy) == "blas":
        parts = _by_blocks(frame, columns, centroids)
        return parts.groupBy("cid").agg(F.sum("members").alias("members"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(columns))))
    rows = frame.select(F.expr(argmin(columns, centroids)).alias("cid"), *columns)
    return rows.groupBy("cid").agg(F.count("*").alias("members"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)))


def kmeans_train(frame: DataFrame, columns: list[str], centroids: list[list[float]], iterations: int, strategy: str | None = None) -> list[list[float]]:
    """Lloyd's passes; a cluster without members keeps its centroid."""
    points = frame.select(*columns).persist()
    try:
        now = [list(c) for c in centroids]
        for _ in range(iterations):
            for r in kmeans_iterate(points, columns, now, strategy).collect():  # a row for each cluster
                now[r["cid"]] = [r[f"s{i}"] / r["members"] for i in range(len(columns))]
        return now
    finally:
        points.unpersist()


def residual(columns: list[str], weights: list[float], label: str) -> str:
    """Predicted probability less the label."""
    return f"({E.sigmoid(E.dot(columns, [E.num(w) for w in weights]))} - {label})"


def _gradients(weights: list[float]) -> Callable:
    """One row (n, g0, g1, ...) of a task; the last column is the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, total = np.array(weights), 0, np.zeros(len(weights))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                with np.errstate(over="ignore"):
                    total += x[:, :-1].T @ (1 / (1 + np.exp(-(x[:, :-1] @ w))) - x[:, -1])
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([g]) for g in total)], ["n", *(f"g{i}" for i in range(len(w)))])

    return run


def logistic_gradient(frame: DataFrame, columns: list[str], weights: list[float], label: str, strategy: str | None = None) -> DataFrame:
    """COUNT, and SUM(residual * column) for each column."""
    if choose(frame.sparkSession, "logistic", len(columns), strategy) == "blas":
        shape = ", ".join(["n long", *(f"g{i} double" for i in range(len(columns)))])
        parts = frame.select(*(F.col(c).cast("double") for c in [*columns, label])).mapInArrow(_gradients(weights), shape).filter("n > 0")
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.sum(f"g{i}").alias(f"g{i}") for i in range(len(columns))))
    rows = frame.select(F.expr(residual(columns, weights, label)).alias("r"), *columns)
    return rows.agg(F.count("*").alias("n"), *(F.sum(F.col("r") * F.col(c)).alias(f"g{i}") for i, c in enumerate(columns)))


def logistic_train(frame: DataFrame, columns: list[str], label: str, iterations: int, rate: float = 0.1, strategy: str | None = None) -> list[float]:
    """Batch gradient descent from zero weights, without an intercept."""
    points = frame.select(*columns, label).persist()
    try:
        weights = [0.0] * len(columns)
        for _ in range(iterations):
            g = logistic_gradient(points, columns, weights, label, strategy).first()
            if g["n"]:
                weights = [w - rate * g[f"g{i}"] / g["n"] for i, w in enumerate(weights)]
        return weights
    finally:
        points.unpersist()
