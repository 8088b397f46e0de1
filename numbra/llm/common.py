"""Shared pieces of the text operators: word splitting on Arrow columns, stable 64-bit word ids
and small helpers for mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from numbra.session import cut, shared_path

__all__ = ["SLICE_BYTES", "Words", "cut", "mix", "ranges", "shared_path", "slices", "strings"]

#: Bytes of text that a task handles at once.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each part hold about `limit` bytes; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def strings(column: pa.Array) -> pa.Array:
    """A text column as large strings with nulls as empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a column of texts, in order, as codes into their distinct values.

    offsets[i]:offsets[i + 1] are the words of text i.
    """

    def __init__(self, column: pa.Array):
        trimmed = pc.ascii_trim_whitespace(strings(column))
        lists = pc.ascii_split_whitespace(trimmed)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths[pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0] = 0
        flat = lists.flatten()
        if len(flat) != lengths.sum():  # an empty text is split into one empty word
            flat = flat.filter(pc.not_equal(flat, ""))
        coded = flat.dictionary_encode()
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.values = coded.dictionary

    def ids(self, fold: bool = False) -> np.ndarray:
        """XXH64 of each word's UTF-8 bytes, optionally with A-Z in lower case; one hash for each distinct word."""
        values = pc.ascii_lower(self.values) if fold else self.values
        table = np.fromiter((xxhash.xxh64_intdigest(x) for x in values.to_pylist()), np.uint64, len(values))
        return table[self.codes] if len(values) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - before + np.repeat(np.asarray(starts, np.int64), lengths)
