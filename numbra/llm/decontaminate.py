"""Benchmark decontamination with spaced seeds.

A seed hashes the words under the ones of a fixed mask and ignores those under its zeros, so it survives a
substituted word. A scan keeps the seeds of each document that a filter of the benchmark's seeds lets pass;
they are hash-joined with the benchmark's seeds; and every document that meets an item in that join is laid
against it wherever seeds agree and compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import Words, cut, mix, slices

#: Five words each; 1: compared, 0: ignored. Any 8 to 20 words of which 80 % agree have a seed of these in common
#: (tests enumerate them), so items of SHORT words or more are found with substitutions, shorter ones as they are.
MASKS = ("110111", "1110011", "11010101")
SHORT = 8
#: The filter has three bits for each seed in at least 2 ** LEAST_BITS and at most 2 ** MOST_BITS bits (16 MB); a
#: benchmark beyond that only lets more seeds into the join.
LEAST_BITS, MOST_BITS, PROBES = 20, 27, 3
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _plain(words: Words) -> np.ndarray:
    """Ids of words in lower case without punctuation; a word of nothing else stays as it is."""
    values = pc.utf8_lower(words.values)
    bare = pc.replace_substring_regex(values, r"[^\p{L}\p{N}]+", "")
    values = pc.if_else(pc.equal(pc.binary_length(bare), 0), values, bare)
    table = np.fromiter((xxhash.xxh64_intdigest(x) for x in values.to_pylist()), np.uint64, len(values))
    return table[words.codes] if len(values) else np.empty(0, np.uint64)


def _seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each position where the mask fits, over one run of ids."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(xxhash.xxh64_intdigest(mask)), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            total += ids[k : k + n] * _ODD[k % 64]
    return mix(total)


def _masks_of(length: int, masks: tuple[str, ...]) -> tuple[str, ...]:
    """The masks of an item of so many words: a short one is one seed of all its words."""
    return masks if length >= SHORT else ("1" * length,) if length else ()


def _item_seeds(masks: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words = Words(part.column("t"))
                ids, items = _plain(words), part.column("item").to_pylist()
                for item, a, b in zip(items, words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
                    found = [_seeds(ids[a:b], m) for m in _masks_of(b - a, masks)]
                    h = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), b - a, np.int32))], ["item", "h", "n"])

    return run


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(64 - bits)) if k == 0 else mix(h ^ _ODD[k]) >> np.uint64(64 - bits) for k in range(PROBES)]


def _filter_words(bits: int) -> Callable:
    """Rows (at, word) with one set bit each of the 64-bit words of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(np.concatenate(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["at", "word"])

    return run


def _scan(held, bits: int, masks: tuple[str, ...]) -> Callable:
    """The texts that have seeds which the filter lets pass, with those seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                ids, offsets = _plain(words), words.offsets
                doc_of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                doc, seed = [], []
                for mask in masks:
                    for low in range(0, len(ids), 1 << 20):
                        h = _seeds(ids[low : low + (1 << 20) + len(mask) - 1], mask)
                        at = np.arange(len(h))
                        for k in range(PROBES):  # most positions end at the first probe
                            slot = (h[at] >> np.uint64(64 - bits)) if k == 0 else mix(h[at] ^ _ODD[k]) >> np.uint64(64 - bits)
                            at = at[(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                        at = at[doc_of[at + low] == doc_of[at + low + len(mask) - 1]]
                        doc.append(doc_of[at + low])
                        seed.append(h[at])
                doc, seed = (np.concatenate(doc), np.concatenate(seed)) if doc else (np.empty(0, np.int64), np.empty(0, np.uint64))
                if not len(doc):
                    continue
                order = np.lexsort((seed, doc))
                doc, seed = doc[order], seed[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])
                doc, seed = doc[new], seed[new]
                rows, starts = np.unique(doc, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array([*starts, len(doc)], pa.int32()), pa.array(seed.view(np.int64)))
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], [*kept.schema.names, "seeds"])

    return run


class Laid:
    """A document against which items are laid."""

    def __init__(self, ids: np.ndarray, masks: tuple[str, ...]):
        self.ids, self.masks, self.sorted = ids, masks, {}

    def seeds(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        if mask not in self.sorted:
            h = _seeds(self.ids, mask)
            order = np.argsort(h, kind="stable")
            self.sorted[mask] = h[order], order
        return self.sorted[mask]

    def matched(self, item: np.ndarray, min_words: int, percent: int) -> int:
        """The most matching words of an overlap in which a seed agrees and `min_words` words in a row (all of a
        shorter item) match to `percent`, an item below SHORT words wholly; 0 for none."""
        n = len(item)
        need, percent = min(n, min_words), percent if n >= SHORT else 100
        there = np.zeros(len(self.ids) + n + 1, bool)  # places of the item's first word, moved by n
        for mask in _masks_of(n, self.masks):
            h, at = self.seeds(mask)
            own = _seeds(item, mask)
            left = np.searchsorted(h, own)
            count = np.searchsorted(h, own, side="right") - left
            for i in np.flatnonzero(count).tolist():
                there[at[left[i] : left[i] + count[i]] - i + n] = True
        best = 0
        for place in (np.flatnonzero(there) - n).tolist():
            skip, stop = max(0, -place), min(n, len(self.ids) - place)
            if stop - skip < max(need, best):
                continue
            same = item[skip:stop] == self.ids[place + skip : place + stop]
            if (total := int(same.sum())) > best:
                gain = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
                if (gain[need:] >= np.minimum.accumulate(gain)[: len(gain) - need]).any():
                    best = total
        return best


def _verify(masks: tuple[str, ...], min_words: int, percent: int) -> Callable:
    """Rows come sorted: a document, then the items that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laid, key = None, None
        for batch in batches:
            for part in slices(batch, "_text"):
                texts, items = (Words(part.column(c)) for c in ("_text", "t"))
                of_texts, of_items = _plain(texts), _plain(items)
                columns = [part.column(c).to_pylist() for c in ("_k1", "_k2", "item")]
                out = []
                for i, (k1, k2, item) in enumerate(zip(*columns, strict=True)):
                    if item is None:
                        laid, key = Laid(of_texts[texts.offsets[i] : texts.offsets[i + 1]].copy(), masks), (k1, k2)
                    elif key == (k1, k2) and (m := laid.matched(of_items[items.offsets[i] : items.offsets[i + 1]], min_words, percent)):
                        out.append((k1, k2, item, m))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["_k1", "_k2", "item", "matched"])

    return run


def _keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("second"), text).alias("_k2")]


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    found: str = "_items",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 13,
    percent: int = 80,
    masks: tuple[str, ...] = MASKS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds to every row the benchmark items its text holds, as array<struct<item_id, matched>>, sorted.

    A document holds an item if, laid against each other without gaps, at least `min_words` words in a row
    (all of a shorter item) match to `percent` or more, and one seed under a mask is equal; an item of fewer
    than eight words, down to one, must stand there word for word. Words are compared in lower case without
    punctuation. Null or empty item texts and null items are never found. Repeated items of one id are found
    once, items of equal texts each. Rows keep all their columns (or those of `keep`); no row is dropped, an
    empty table stays empty, an empty benchmark marks nothing. `found`, _k1 and _k2 must not be columns.

    The scan broadcasts a filter of at most 16 MB, whatever the size of the benchmark.
    """
    if clash := {found, "_k1", "_k2"} & set(docs.columns):
        raise ValueError(f"columns are called {clash}")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t")).dropna().distinct()
    items = cut(items.withColumn("item", F.xxhash64("t")))
    texts = items.select("item", "t").dropDuplicates(["item"])
    seeds = cut(texts.mapInArrow(_item_seeds(masks), "item long, h long, n int"))
    total = seeds.count()
    short = [r["n"] for r in seeds.filter(F.col("n") < SHORT).select("n").distinct().collect()]  # seven lengths at most
    bits = min(MOST_BITS, max(LEAST_BITS, (total * 64).bit_length()))
    words = seeds.select("h").mapInArrow(_filter_words(bits), "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(table)
    used = (*(masks if total else ()), *("1" * n for n in sorted(short)))
    rows = docs.select(*_keys(F.col(text_col)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    hits = cut(rows.mapInArrow(_scan(held, bits, used), "_k1 long, _k2 long, _text string, seeds array<long>"))
    pairs = hits.select("_k1", "_k2", F.explode("seeds").alias("h")).join(seeds.select("item", "h"), "h").select("_k1", "_k2", "item").distinct()
    pairs = cut(pairs)
    met = hits.select("_k1", "_k2", "_text").join(pairs.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    laid = met.select("_k1", "_k2", "_text", F.lit(None).cast("long").alias("item"), F.lit(None).cast("string").alias("t"))
    laid = laid.unionByName(pairs.join(texts, "item").select("_k1", "_k2", F.lit(None).cast("string").alias("_text"), "item", "t"))
    # nulls come first, so a document comes before its items; it is one task's longest group
    laid = laid.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", F.asc_nulls_first("item"))
    verified = laid.mapInArrow(_verify(masks, min_words, percent), "_k1 long, _k2 long, item long, matched long")
    one = F.struct("item_id", "matched")
    # cut, so that Spark can split the rows of a hot text
    lists = cut(verified.join(items.select("item", "item_id"), "item").groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set(one)).alias(found)))
    kept = docs.select(*(keep or docs.columns), *_keys(F.col(text_col)))
    out = kept.join(lists, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    return out.withColumn(found, F.coalesce(found, F.array().cast("array<struct<item_id:bigint,matched:bigint>>")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, contaminated, n_items, item_ids (sorted, comma-joined), most_matched.

    See mark() for what counts. A null id is kept as null, repeated rows are judged each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = mark(rows, benchmark, "_text", "_items", keep=["_id"], **options)
    ids = F.array_sort(F.array_distinct(F.transform("_items", lambda x: x["item_id"])))
    return out.select(
        F.col("_id").alias(id_col),
        (F.size("_items") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("_items", lambda x: x["matched"])), F.lit(0)).cast("long").alias("most_matched"),
    )
