"""Dense shapes with two strategies: SQL expressions for Catalyst, and NumPy blocks over Arrow batches.

Both give the same answer up to rounding. Block results never decide which rows a query returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.plans.strategy import choose
from numbra.session import setting


def triangle_index(d: int, i: int, j: int) -> int:
    """Place of (i, j), i <= j, in the row-major upper triangle."""
    return i * d - i * (i - 1) // 2 + (j - i)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else values.reshape(0, 0)


def flat(frame: DataFrame, vector: str, width: int, prefix: str = "c", kind: str = "double") -> DataFrame:
    """The first `width` elements of an array column as columns of their own, beside all others."""
    rest = [c for c in frame.columns if c != vector]
    return frame.select(*rest, *(F.col(vector)[i].cast(kind).alias(f"{prefix}{i}") for i in range(width)))


def _gram_blocks(d: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((d, d)), 0
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(kind, copy=False)
                total += x.T @ x
                rows += len(x)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * (d + 1) // 2, dtype=np.int32)), pa.array(total[np.triu_indices(d)])], ["place", "x"])

    return run


def _one_row(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[float | None] = [None] * len(names)
        for batch in batches:
            for place, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if place >= 0:
                    found[place] = x
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in found], names)

    return run


def gram_matrix(frame: DataFrame, features: list[str], strategy: str | None = None, single: bool = False) -> DataFrame:
    """One row of SUM(fi * fj) for i <= j, columns g_i_j in row-major order.

    `features` are SQL expressions of doubles without nulls. No rows give nulls. The block strategy makes one
    triangle for each partition, in one grouped sum; `single` multiplies blocks of single precision, whose sums
    over blocks are double. The last step holds one number for each pair of features.
    """
    d = len(features)
    named = frame.select(*(F.expr(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    if not single and choose(frame.sparkSession, "gram", d, strategy) == "catalyst":
        return named.agg(*(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"g_{i}_{j}") for i, j in pairs))
    parts = named.mapInArrow(_gram_blocks(d, np.float32 if single else np.float64), "place int, x double")
    # a row that keeps the last step from being planned away where there are no rows
    sums = parts.groupBy("place").agg(F.sum("x").alias("x")).unionByName(frame.sparkSession.range(1).select(F.lit(-1).alias("place"), F.lit(None).cast("double").alias("x")))
    names = [f"g_{i}_{j}" for i, j in pairs]
    return sums.coalesce(1).mapInArrow(_one_row(names), ", ".join(f"{n} double" for n in names))


def _pack(rows: int):
    """Rows (band, id, vector) as blocks (band, ids, vectors) of at most `rows` vectors of one band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            order = np.argsort(pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), kind="stable")
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)[order]
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b or codes[a] < 0:  # no band equals a null one
                    continue
                for i in range(a, b, rows):
                    part = batch.take(pa.array(order[i : min(b, i + rows)]))
                    ids = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                    out.append((coded.dictionary[int(codes[a])].as_py(), ids.tobytes(), matrix(part.column(2)).astype(np.float64).tobytes()))
            if out:
                kinds = [batch.schema.field(0).type, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["band", "ids", "vectors"])

    return run


def _best(others: bool):
    """Rows of two blocks; the best partner of each query of the first in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, ri, rv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, refs = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                order = np.argsort(refs, kind="stable")  # the first of equal scores has the lowest id
                refs = refs[order]
                scores = np.frombuffer(qv).reshape(len(ids), -1) @ np.frombuffer(rv).reshape(len(refs), -1)[order].T
                if others:
                    scores[ids[:, None] == refs[None, :]] = -np.inf
                best, rows = scores.argmax(axis=1), np.arange(len(ids))
                keep = scores[rows, best] > -np.inf
                found = [ids[keep], refs[best][keep], scores[rows, best][keep]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["qid", "rid", "score"])

    return run


def reference_join(
    queries: DataFrame, refs: DataFrame, query_id: str, ref_id: str, vector: str = "embedding",
    strategy: str | None = None, band: str | None = None, others: bool = False,
) -> DataFrame:
    """(qid, rid, score): the reference of largest inner product for each query row; the lowest id wins ties.

    With `band` only rows of an equal band meet, and a null band meets none; with `others` a query does not
    meet a reference of its own id. Vectors have one width and no nulls, ids are not null; repeated query ids
    give one row. Queries without a partner, and empty tables, give no rows.

    Both sides are packed into blocks where they lie. The blocks of queries go to every cell of their band, a
    block of references to one, and each pair of blocks is one matrix product, of which the best of each query
    leaves: rows are never paired in a plan, nothing passes the driver, and a hot band is spread over all cells.
    The strategy `catalyst` is the control arm: it pairs rows, and refuses more than numbra.neighbour.max-pairs.
    """
    spark = queries.sparkSession
    kept = (lambda f: F.col(band)) if band else (lambda f: F.lit(0))
    q = queries.select(kept(queries).alias("band"), F.col(query_id).cast("long").alias("qid"), F.col(vector).alias("qv"))
    r = refs.select(kept(refs).alias("band"), F.col(ref_id).cast("long").alias("rid"), F.col(vector).alias("rv"))
    if choose(spark, "neighbour", 1, strategy) == "catalyst":
        if (n := q.count() * r.count()) > int(setting(spark, "numbra.neighbour.max-pairs")):
            raise ValueError(f"{n} pairs of rows are too many to compare one by one")
        product = F.aggregate(F.zip_with("qv", "rv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
        pairs = q.join(r, "band").filter(F.lit(not others) | (F.col("qid") != F.col("rid"))).select("qid", "rid", product.alias("score"))
    else:
        cells, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), int(setting(spark, "numbra.block.rows"))
        kind = dict(q.dtypes)["band"]
        blocks = q.mapInArrow(_pack(rows), f"band {kind}, ids binary, vectors binary")
        blocks = blocks.select("band", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
        dealt = r.mapInArrow(_pack(rows), f"band {kind}, ids binary, vectors binary")
        dealt = dealt.select("band", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int").alias("cell"), F.col("ids").alias("ri"), F.col("vectors").alias("rv"))
        pairs = blocks.join(dealt, ["band", "cell"]).select("qi", "qv", "ri", "rv").mapInArrow(_best(others), "qid long, rid long, score double")
    best = pairs.groupBy("qid").agg(F.max_by(F.struct("rid", "score"), F.struct("score", -F.col("rid"))).alias("x"))
    return best.select("qid", "x.rid", "x.score")


def nearest_neighbour(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, vector: str = "embedding", strategy: str | None = None, others: bool = False) -> DataFrame:
    """(qid, score): MAX of the inner products of each query with the corpus; see reference_join()."""
    return reference_join(queries, corpus, query_id, corpus_id, vector, strategy, others=others).select("qid", "score")


def nearest_neighbour_banded(
    queries: DataFrame, corpus: DataFrame, query_id: str, band: str, vector: str = "embedding", corpus_id: str | None = None, others: bool = False
) -> DataFrame:
    """(qid, score): MAX of the inner products within an equal band; see reference_join()."""
    return reference_join(queries, corpus, query_id, corpus_id or query_id, vector, band=band, others=others).select("qid", "score")
