"""The near-copy stage of the SimHash operator: similarity of word shingles, verified.

Candidates come from the generalised pigeonhole search of numbra.llm.simhash over fingerprints of five-word
shingles: groups of texts whose fingerprints link. Each group is then verified on the whole sets of shingles:
first every text against the group's least one, which makes stars, then, in one task for each block of a group,
all pairs that the stars left apart. Groups of true near copies thus cost one comparison for each text, and a link
that only two others of a group have is still found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import Words, cut, mix, ranges, slices, strings
from numbra.llm.components import components, local_forest
from numbra.llm.simhash import links

#: Words of 64 bits of a fingerprint, bits in which two may differ and surely be met, and bits up to which a met
#: pair is a candidate. Texts with a similarity of 0.8 differ in about 39 of 256 bits, others in 128; all within 24
#: bits are met, and a pair at 0.8 agrees in one of the 25 parts of that plan with a probability of 0.99.
WORDS, LIMIT, WITHIN = 4, 24, 64
#: Words of a shingle and least similarity in percent.
SHINGLE, LEAST = 5, 80
#: Texts of a group in a block; two blocks meet in one task.
BLOCK = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, words: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case; a shorter text is one shingle."""
    split = Words(column)
    ids = split.ids(fold=True)
    out = []
    for a, b in zip(split.offsets[:-1].tolist(), split.offsets[1:].tolist(), strict=True):
        own, k = ids[a:b], min(words, b - a)
        h = np.full(max(1, b - a - k + 1), k, np.uint64)
        for j in range(k):
            h = mix(h * _GOLD + own[j : j + len(h)])
        out.append(np.unique(h))
    return out


def sign(h: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of `words` numbers: bit i is 1 if over half of the shingles of a text have it in their i-th hash bit."""
    ends = np.append(starts[1:], len(h))
    out, salts = np.zeros((len(starts), words), np.uint64), mix(np.arange(1, words + 1, dtype=np.uint64) * _GOLD)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 16), side="right")))
        for w in range(words):
            counts = np.zeros((stop - at, 64), np.int64)
            # a text beyond that size comes alone and in pieces
            for low in range(int(starts[at]), int(ends[stop - 1]), 1 << 17):
                part = mix(h[low : min(low + (1 << 17), int(ends[stop - 1]))] ^ salts[w])
                bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
                counts += np.add.reduceat(bits, starts[at:stop] - starts[at] if stop - at > 1 else [0], axis=0, dtype=np.int32)
            set_ = 2 * counts > (ends[at:stop] - starts[at:stop])[:, None]
            out[at:stop, w] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
        at = stop
    return out


def _signatures(shingle: int, words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(part.column("_text"), shingle)
                sizes = np.array([len(x) for x in sets])
                found = sign(np.concatenate(sets), np.cumsum(sizes) - sizes, words)
                yield pa.RecordBatch.from_arrays([part.column("_node"), *(pa.array(found[:, w].view(np.int64)) for w in range(words))], ["node", *(f"w{w}" for w in range(words))])

    return run


def _similar(words: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_ta"):
                ok = []
                # texts come again and again in links, but are split once for each slice
                texts = pa.concat_arrays([strings(part.column(x)) for x in ("_ta", "_tb")]).dictionary_encode()
                sets, at = shingle_sets(texts.dictionary, words), texts.indices.to_numpy(zero_copy_only=False)
                for i, j in zip(at[: part.num_rows].tolist(), at[part.num_rows :].tolist(), strict=True):
                    x, y = sets[i], sets[j]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= least * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _across(words: int, least: int) -> Callable:
    """Rows come sorted by key and cell; links between the different roots of similar texts of a cell."""

    def settle(roots: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, counts = np.unique(roots, return_counts=True)
        # every pair with different roots has one outside of the largest component
        outside = np.flatnonzero(roots != names[np.argmax(counts)])
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
        first, step, a, b = np.cumsum(often) - often, max(1, (1 << 20) // len(sets)), [], []
        for x in outside.tolist():
            own, both = codes[ends[x] - sizes[x] : ends[x]], np.zeros(len(sets), np.int64)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                both += np.bincount(owner[ranges(first[part], often[part])], minlength=len(sets))
            near = np.flatnonzero((100 * both >= least * (sizes[x] + sizes - both)) & (roots != roots[x]))
            a.append(np.full(len(near), roots[x]))
            b.append(roots[near])
        return local_forest(np.concatenate(a), np.concatenate(b)) if a else (roots[:0], roots[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def drain() -> pa.RecordBatch:
            a, b = settle(np.array(held[0], np.int64), held[1])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for part in slices(batch, "_text"):
                columns = [part.column(x).to_pylist() for x in ("key", "cell", "root")]
                for key, cell, root, found in zip(*columns, shingle_sets(part.column("_text"), words), strict=True):
                    if at != (key, cell):
                        if held[0]:
                            yield drain()
                        at, held = (key, cell), ([], [])
                    held[0].append(root)
                    held[1].append(found)
        if held[0]:
            yield drain()

    return run


def near_components(texts: DataFrame, words: int = SHINGLE, least: int = LEAST, limit: int = LIMIT, within: int = WITHIN, block: int = BLOCK) -> DataFrame:
    """(node, root): every node that a similar pair met by the search links, with one node of its component.

    `texts` has rows of _node long and _text string; equal texts have equal nodes and may repeat.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        # the side with hubs comes last, in a join that Spark splits when it is skewed
        both = pairs.join(whole.select(F.col("_node").alias("b"), F.col("_text").alias("_tb")), "b")
        both = both.join(whole.select(F.col("_node").alias("a"), F.col("_text").alias("_ta")), "a")
        return cut(both.select("a", "b", "_ta", "_tb").mapInArrow(_similar(words, least), "a long, b long"))

    shape = "node long, " + ", ".join(f"w{w} long" for w in range(WORDS))
    prints = cut(texts.select("_node", "_text").mapInArrow(_signatures(words, WORDS), shape).dropDuplicates(["node"]))
    groups = components(links(prints, limit, WORDS, within))
    # the root is the least node of a group
    held = cut(groups.select(F.col("root").alias("key"), "node").unionByName(groups.select(F.col("root").alias("key"), F.col("root").alias("node")).distinct()))
    # only texts of groups from here on
    whole = texts.join(held.select(F.col("node").alias("_node")), "_node", "left_semi")
    whole = cut(whole.select("_node", "_text").dropDuplicates(["_node"]))
    # each link has its group's least node, so the links are stars: a node's root is known without any rounds
    stars = verified(held.filter("node <> key").select(F.col("key").alias("a"), F.col("node").alias("b"))).select(F.col("b").alias("node"), F.col("a").alias("root"))
    rooted = held.join(stars, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # groups that the stars did not connect whole. What a star holds needs no comparison within: its rows go, in blocks,
    # to each block of the others, and those meet each other; cell i * (outer + inner) + j has blocks i and j
    alone = F.col("root") != F.col("key")
    open_ = rooted.groupBy("key").agg(F.count_if(alone).alias("outer"), F.count_if(~alone).alias("inner")).filter("outer > 0")
    open_ = cut(open_.select("key", *(F.ceil(F.col(x) / block).cast("long").alias(x) for x in ("outer", "inner"))))
    rooted = rooted.join(open_, "key")
    outer, inner, h = F.col("outer"), F.col("inner"), F.xxhash64("node")
    mine = F.when(alone, F.pmod(h, outer)).otherwise(outer + F.pmod(h, inner))
    others = F.sequence(F.lit(0).cast("long"), F.when(alone, outer + inner - 1).otherwise(outer - 1))
    cells = F.transform(others, lambda x: F.least(x, mine) * (outer + inner) + F.greatest(x, mine))
    rooted = rooted.select("key", F.explode(cells).alias("cell"), "node", "root").join(whole, F.col("node") == F.col("_node"))
    rooted = rooted.select("key", "cell", "root", "_text").repartition("key", "cell").sortWithinPartitions("key", "cell")
    joined = components(rooted.mapInArrow(_across(words, least), "a long, b long"))
    moved = stars.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    return joined.unionByName(moved.select("node", F.coalesce("_to", "root").alias("root")))


def keep_near_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The rows of the smallest id of each component of near copies, with all their columns.

    Texts link when at least `least` percent of their distinct shingles of `words` words are common (A-Z in lower
    case). Null and blank texts are copies of each other. Rows that repeat the smallest id stay together, and so do
    rows of a component without any id. No column of docs may be called _keep_id. Other columns are kept as they are;
    an empty table stays empty.
    """
    if "_keep_id" in docs.columns:
        raise ValueError("_keep_id is a column already")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("_node"), "_text")
    owners = cut(rows.groupBy("_node").agg(F.min("_id").alias("_low")))
    found = near_components(rows.select("_node", "_text"), words, least)
    owners = owners.join(found, owners["_node"] == found["node"], "left").select("_node", "_low", F.coalesce("root", "_node").alias("_root"))
    kept = owners.groupBy("_root").agg(F.min("_low").alias("_keep_id")).select("_keep_id").distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_keep_id"]), "left_semi")
