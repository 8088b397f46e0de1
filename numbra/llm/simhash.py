"""SimHash fingerprints and their links by the generalised pigeonhole principle.

A fingerprint has one or several words of 64 bits. Bits that go together are grouped into parts. If two fingerprints differ in at most `limit` bits, then for
part thresholds with sum limit - parts + 1 they differ by no more than its threshold in at least one part.
The thresholds come from dynamic programming on candidate counts that are estimated from the bit statistics
of all fingerprints, and so does the number of parts. Each fingerprint probes the values within a part's
threshold, candidates are verified on all bits, and a task returns a spanning forest of the links it
found, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import cut, mix, slices
from numbra.llm.components import components, local_forest

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Relative costs of a probe row (made, sorted, shuffled) and of a verified candidate pair.
PROBE_COST, PAIR_COST = 400.0, 1.0
#: Fingerprints of a bucket that one probe row is held against; a larger bucket is split into blocks.
BLOCK = 1 << 14


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the text's shingles."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(x) + 1 for x in tokens))
    starts = [0, *ends]
    k = min(words, len(tokens))
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[s : e - 1], seed) for s, e in zip(starts, ends[k - 1 :])], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = np.array([simhash(x, words, seed) for x in part.column("_text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found.view(np.int64))], ["_id", "_fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(_id, _fp): the 64-bit fingerprint of every row as a signed long. Null and blank texts have 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_fingerprints(words, seed), "_id long, _fp long")


def _packed(batch: pa.RecordBatch, words: int, first: int = 1) -> np.ndarray:
    """Fingerprints as rows of `words` unsigned numbers."""
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(words)])


def _bit_counts(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((64 * words, 64 * words)), 0
        for batch in batches:
            prints = np.ascontiguousarray(_packed(batch, words))
            for i in range(0, len(prints), 1 << 14):
                part = prints[i : i + (1 << 14)]
                bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                rows += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "joint"])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, total = 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            rows += batch.column(0)[i].as_py()
            x = batch.column(1)[i].values.to_numpy()
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total], pa.list_(pa.float64()))], ["n", "joint"])


def bit_statistics(prints: DataFrame, words: int = 1) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the square counts of bits set together, over all rows of (node, w0, w1, ...)."""
    shape = "n long, joint array<double>"
    # one small matrix for each task; eight tasks add them up, eight matrices come to the driver
    parts = prints.mapInArrow(_bit_counts(words), shape).repartition(8).mapInArrow(_add_counts, shape).toArrow()
    n, size = sum(parts.column("n").to_pylist()), 64 * words
    return n, sum((x.values.to_numpy() for c in parts.column("joint").chunks for x in c), np.zeros(size * size)).reshape(size, size)


def group_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size; each group grows by the bit most correlated with it."""
    bits = len(joint)
    mean = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tie = np.abs((joint / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    free, groups = np.ones(bits, bool), []
    for k in range(parts):
        size = bits * (k + 1) // parts - bits * k // parts
        group, score = [], np.zeros(bits)
        for _ in range(size):
            best = int(np.argmax(np.where(free, score, -1.0)))  # the lowest of equal ones
            free[best] = False
            score += tie[best]
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(n: int, mean: np.ndarray, groups: list[list[int]], limit: int) -> tuple[float, list[int]]:
    """Least estimated cost and the part thresholds (-1: part unused) whose sum is limit - parts + 1."""
    n, costs = max(n, 1), []  # without fingerprints every plan would cost nothing
    for group in groups:
        differ = np.array([1.0])
        for j in group:
            p = 2 * mean[j] * (1 - mean[j])
            differ = np.convolve(differ, [1 - p, p])
        row = {-1: 0.0}
        for t in range(min(limit, len(group)) + 1):
            ball = sum(math.comb(len(group), i) for i in range(t + 1))
            row[t] = PROBE_COST * n * ball + PAIR_COST * n * n / 2 * float(differ[: t + 1].sum())
        costs.append(row)
    need = limit - len(groups) + 1
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, x in row.items():
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*chosen, t])
        best = step
    return best[need]


def plan_parts(n: int, joint: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """The used parts (bits, threshold) of the cheapest plan."""
    mean = np.diag(joint) / max(n, 1)
    plans = []
    for parts in range(1, limit + 2):
        groups = group_bits(n, joint, parts)
        cost, chosen = allocate(n, mean, groups, limit)
        plans.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _mask(bits: list[int], words: int) -> list[int]:
    out = [0] * words
    for j in bits:
        out[j // 64] |= 1 << (j % 64)
    return out


def _probes(parts: list[tuple[list[int], int]], words: int) -> Callable:
    """Rows (part, value, own, node, w0, ...): a bucket's key is the part's number and the (hashed) value of its
    bits; own: the value is the fingerprint's."""
    flips = []
    for bits, t in parts:
        masks = [[0] * words]
        for k in range(1, t + 1):
            masks += [_mask(list(c), words) for c in combinations(bits, k)]
        flips.append((np.array(_mask(bits, words), np.uint64), np.array(masks, np.uint64)))
    names = ["part", "value", "own", "node", *(f"w{i}" for i in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, node = _packed(batch, words), batch.column(0).to_numpy(zero_copy_only=False)
            for k, (mask, masks) in enumerate(flips):
                step = max(1, (1 << 18) // len(masks))
                for i in range(0, len(prints), step):
                    part = prints[i : i + step]
                    value = np.zeros(len(part) * len(masks), np.uint64)
                    for w in np.flatnonzero(mask):
                        value = mix(value ^ ((part[:, w] & mask[w])[:, None] ^ masks[None, :, w]).ravel()) if words > 1 else ((part[:, w] & mask[w])[:, None] ^ masks[None, :, w]).ravel()
                    own = np.zeros((len(part), len(masks)), bool)
                    own[:, 0] = True
                    columns = [np.full(len(value), k, np.int32), value.view(np.int64), own.ravel(), np.repeat(node[i : i + step], len(masks))]
                    columns += [np.repeat(part[:, w], len(masks)).view(np.int64) for w in range(words)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return run


#: Rows of a bucket from which one row at a time is held against all others, instead of all at one distance.
LARGE = 256


def _verify(limit: int, words: int) -> Callable:
    """Rows come sorted by part and value; links that connect what the close pairs of each bucket connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b, held = [], [], 0
        waiting: list[list[np.ndarray]] = []

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal found_a, found_b, held
            if not len(a):
                return
            found_a.append(a)
            found_b.append(b)
            held += len(a)
            if held > 1 << 20:
                x, y = local_forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [x], [y], 0

        def near(f: np.ndarray, g: np.ndarray) -> np.ndarray:
            return np.bitwise_count(f ^ g).sum(axis=1, dtype=np.int32) <= limit

        def crowd(o: np.ndarray, n: np.ndarray, f: np.ndarray) -> None:
            """All rows against the first one; then each that this did not link to it against all."""
            first = int(np.argmax(o))  # some row is its own
            close = near(f, f[first][None, :]) & (n != n[first]) & (o | o[first])
            keep(np.full(int(close.sum()), n[first]), n[close])
            linked = close | (n == n[first])
            for i in np.flatnonzero(~linked).tolist():
                close = near(f, f[i][None, :]) & (n != n[i]) & (o | o[i])
                keep(np.full(int(close.sum()), n[i]), n[close])

        def settle(p: np.ndarray, v: np.ndarray, o: np.ndarray, n: np.ndarray, f: np.ndarray) -> None:
            if not len(p):
                return
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (v[1:] != v[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(p)]])
            small = np.ones(len(p), bool)
            for a, b in zip(starts[ends - starts >= LARGE].tolist(), ends[ends - starts >= LARGE].tolist(), strict=True):
                small[a:b] = False
                if o[a:b].any():
                    crowd(o[a:b], n[a:b], f[a:b])
            end_of = np.repeat(ends, ends - starts)
            at, step = np.flatnonzero(small), 1
            while len(at := at[at + step < end_of[at]]):
                a, b = at, at + step
                ok = (o[a] | o[b]) & (n[a] != n[b])
                a, b = a[ok], b[ok]
                ok = near(f[a], f[b])
                keep(n[a[ok]], n[b[ok]])
                step += 1

        def drain(last: bool) -> None:
            nonlocal waiting
            if not waiting:
                return
            p, v, o, n, f = (np.concatenate(x) for x in zip(*waiting, strict=True))
            stop = len(p) if last else int(np.argmax((p == p[-1]) & (v == v[-1])))
            settle(p[:stop], v[:stop], o[:stop], n[:stop], f[:stop])
            waiting = [[x[stop:] for x in (p, v, o, n, f)]]

        for batch in batches:
            if batch.num_rows:
                waiting.append([*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), _packed(batch, words, 4)])
                if sum(len(x[0]) for x in waiting) > 1 << 17:
                    drain(False)
        drain(True)
        if found_a:
            a, b = local_forest(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(prints: DataFrame, limit: int = 4, words: int = 1, within: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links of nodes that connect what the links of all fingerprints within `limit` bits do.

    `prints` has rows (node, w0, w1, ...) of longs with distinct nodes. With `within` above `limit` the search
    also keeps pairs that it happens to meet up to that many bits: all pairs within `limit` bits are met, of
    wider ones those that agree in some part. A bucket with more than `block` rows is dealt to as many blocks
    as that needs: each row goes to one block as it is, and the bucket's own fingerprints of one block meet
    those of another in a task for that pair of blocks, so no task holds a bucket whole.
    """
    n, joint = bit_statistics(prints, words)
    parts = plan_parts(n, joint, limit)
    more = [f"w{i}" for i in range(words)]
    rows = prints.mapInArrow(_probes(parts, words), "part int, value long, own boolean, node long, " + ", ".join(f"{w} long" for w in more))
    large = rows.groupBy("part", "value").agg(F.count("*").alias("rows")).filter(F.col("rows") > block)
    # at most rows / block buckets are large; they decide how a row is dealt
    large = cut(large.select("part", "value", F.ceil(F.col("rows") / block).cast("int").alias("blocks")))
    if large.isEmpty():
        dealt = rows.withColumn("cell", F.lit(0))
    else:
        rows = rows.join(large, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        # cell i * blocks + j (i <= j) holds the rows of blocks i and j
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
        dealt = rows.withColumn("cell", F.explode(cells)).drop("blocks")
    dealt = dealt.repartition("part", "value", "cell").select((F.col("part") + F.col("cell").cast("long") * 1024).alias("part"), "value", "own", "node", *more)
    return dealt.sortWithinPartitions("part", "value").mapInArrow(_verify(limit if within is None else within, words), "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, limit: int = 4, seed: int = 42
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Rows link when their fingerprints differ in at most `limit` bits; component_id is the smallest id that
    links reach, the row's own included. Null and blank texts have fingerprint zero. A null id takes part in
    links and is never the smallest, unless all ids of a component are null: then component_id is null.
    Repeated rows are rows of their own. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words, seed))
    # nodes are ordered by their smallest ids, so the root of a component has the answer and nobody asks for it by key;
    # the fingerprint keeps nodes apart whose rows repeat an id
    name = F.struct(F.col("_low").isNull().alias("none"), F.col("_low").alias("id"), F.col("_fp").alias("fp"))
    owners = cut(prints.groupBy("_fp").agg(F.min("_id").alias("_low")).select("_fp", name.alias("_node")))
    found = links(owners.select("_fp", F.col("_fp").alias("w0")), limit)
    found = found.join(owners.select(F.col("_fp").alias("a"), F.col("_node").alias("x")), "a")
    found = found.join(owners.select(F.col("_fp").alias("b"), F.col("_node").alias("y")), "b")
    roots = components(found, "x", "y").select(F.col("node.fp").alias("_fp"), F.col("root.id").alias("_root"), F.lit(True).alias("_linked"))
    named = owners.join(roots, "_fp", "left").select("_fp", F.when(F.col("_linked"), F.col("_root")).otherwise(F.col("_node.id")).alias("component_id"))
    # cut, so that Spark can split the rows of a hot fingerprint
    return prints.join(cut(named), "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
