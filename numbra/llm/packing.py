"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document goes where the sum over gaps of the squared number of open sequences with that gap becomes
smallest. Pieces are dealt to groups of a fixed mean size, so the number of tasks follows the data; the
sequences that a group leaves open are then packed as wholes by the same rule.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import Words, cut, ranges, slices, strings

#: Mean number of pieces that one task packs.
GROUP_ROWS = 16384
#: Distinct words that a worker remembers the ids of.
CACHE_WORDS = 800_000

#: The vocabulary's own pre-tokeniser, as what stands apart from the letters around it.
_APART = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+)"
#: White space below U+0130 that is not ASCII.
_BLANK = r"[\x{85}\x{a0}]"


class Encoder:
    """Token ids of texts, for vocabularies whose tokens never cross white space and end words with </w>.

    Texts whose characters are all below U+0130 (no normal form changes these, and their lower cases are
    one to one) are cut into words on Arrow columns, and only new words reach the merges, many at a time.
    Texts with other characters or with `<|` take the full tokeniser. `whole=True` gives every text to
    it, for vocabularies of any other kind.
    """

    def __init__(self, path: str, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        if not whole:
            parts = json.loads(self.tokenizer.to_str())
            level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            words = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
            self.merges = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "added_tokens": [], "pre_tokenizer": words}))
            self.ends = np.zeros(max(parts["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for w, i in parts["model"]["vocab"].items() if w.endswith("</w>")]] = True
            self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.table = np.zeros(1, np.int64), np.empty(0, "<u4")  # ids of word i: table[starts[i]:starts[i + 1]]

    def _learn(self, words: list[str]) -> None:
        tables, starts = [self.table], [self.starts]
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("this vocabulary does not mark word ends; use whole=True")
            tables.append(ids)
            starts.append(starts[-1][-1] + cuts)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.table, self.starts = np.concatenate(tables), np.concatenate(starts)

    def _of(self, values: list[str]) -> np.ndarray:
        """Indexes of distinct words, which are learnt first where they are new."""
        found = np.array([self.index.get(w, -1) for w in values], np.int64)
        if (unseen := np.flatnonzero(found < 0)).size:
            if len(self.index) + unseen.size > CACHE_WORDS:
                self._forget()
                unseen = np.arange(len(values))
            first = len(self.index)
            self._learn([values[i] for i in unseen.tolist()])
            if first == 0:
                return np.arange(len(values))
            found[unseen] = np.arange(first, first + unseen.size)
        return found

    def _by_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct stretches between white space are cut into words, distinct words into ids."""
        cut = Words(column)
        plain = pc.utf8_lower(pc.replace_substring_regex(cut.values, _BLANK, " "))
        inner = Words(pc.replace_substring_regex(plain, _APART, r" \1 "))
        word = self._of(inner.values.to_pylist())[inner.codes] if len(inner.codes) else np.empty(0, np.int64)
        lengths = self.starts[word + 1] - self.starts[word]
        ids = self.table[ranges(self.starts[word], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[inner.offsets]  # of each stretch in ids
        each = np.diff(ends)[cut.codes] if len(cut.codes) else np.empty(0, np.int64)
        return ids[ranges(ends[cut.codes], each)], np.concatenate([[0], np.cumsum(each)])[cut.offsets]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is the empty text."""
        column = strings(column)
        odd = np.ones(len(column), bool) if self.whole else pc.match_substring_regex(column, r"[^\x00-\x{12f}]|<\|").to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(column)
        if not odd.all():
            ids, offsets = self._by_words(column.filter(pa.array(~odd)))
            for i, a, b in zip(np.flatnonzero(~odd).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        if odd.any():
            found = self.tokenizer.encode_batch(column.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
            for i, x in zip(np.flatnonzero(odd).tolist(), found, strict=True):
                out[i] = np.array(x.ids, "<u4")
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _cutter(path: str, whole: bool, size: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, whole) not in _ENCODERS:
            _ENCODERS[path, whole] = Encoder(path, whole)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "_text", 16 << 20):
                rows = []
                for d, ids in zip(part.column("_id").to_pylist(), _ENCODERS[path, whole].encode(part.column("_text")), strict=True):
                    ids = ids.tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[at : at + 4 * size]
                        rows.append((d, k, at // 4, len(piece) // 4, zlib.crc32(piece), *((piece,) if with_ids else ())))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item in the given order, and the filled length of each bin.

    Among equal choices the smallest gap wins, and an open bin before a new one.
    """
    count = np.zeros(size + 1, np.int64)  # open bins by gap; 0 stays 0
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    live = np.zeros(size + 1, bool)
    for i, s in enumerate(np.asarray(lengths).tolist()):
        if s == size:
            bins[i], offsets[i] = len(fill), 0
            fill.append(size)
            continue
        # change of the sum of squares: 2 N[g-s] - 2 N[g] + 2 from gap g, 1 - 2 N[s] when that closes the bin
        view = np.where(live[s:], 2 * (count[: size + 1 - s] - count[s:]) + 2, 1 << 40)
        view[0] = 1 - 2 * count[s] if live[s] else 1 << 40
        k = int(view.argmin())
        if view[k] <= 2 * count[size - s] + 1:
            gap = s + k
            b = open_bins[gap].pop()
            count[gap] -= 1
            live[gap] = count[gap] > 0
            rest = k
        else:
            b, gap, rest = len(fill), size, size - s
            fill.append(0)
        bins[i], offsets[i] = b, size - gap
        fill[b] = size - rest
        if rest:
            open_bins[rest].append(b)
            count[rest] += 1
            live[rest] = True
    return bins, offsets, np.array(fill, np.int64)


def _pack(size: int, what: str) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_length", *[x for x in rows.columns if x.startswith("_k")]], ascending=False, kind="stable")
        bins, offsets, fill = sum_of_squares(rows["_length"].to_numpy(), size)
        rows["_bin"] = (np.int64(key[0]) << 32) + bins
        rows["_at"], rows["_fill"] = offsets, fill[bins]
        return rows.drop(columns=["_group"])

    return run


def pack(pieces: DataFrame, size: int, keys: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns `keys` and length, 1 to `size`).

    Sequences are gapless from 0 and hold whole pieces. Pieces that repeat keys are packed one by one.
    """
    names = pieces.columns
    groups = max(1, -(-pieces.count() // group_rows))
    small = pieces.withColumnsRenamed({x: f"_k{i}" for i, x in enumerate(names)} | {"length": "_length"})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema)
    dealt = small.withColumn("_group", F.pmod(F.xxhash64(*[x for x in small.columns]), F.lit(groups)))
    first = cut(dealt.groupBy("_group").applyInPandas(_pack(size, "piece"), f"{fields}, _bin long, _at long, _fill long"))
    left = first.filter(F.col("_fill") < size).groupBy("_bin").agg(F.first("_fill").alias("_length")).withColumnRenamed("_bin", "_k0")
    again = max(1, -(-left.count() // group_rows))
    second = (
        left.withColumn("_group", F.pmod(F.xxhash64("_k0"), F.lit(again)))
        .groupBy("_group")
        .applyInPandas(_pack(size, "bin"), "_k0 long, _length long, _bin long, _at long, _fill long")
        .select(F.col("_k0").alias("_bin"), F.col("_bin").alias("_seq"), F.col("_at").alias("_base"))
    )
    out = first.join(second, "_bin", "left")
    return out.select(
        *[F.col("_length" if x == "length" else f"_k{i}").alias(x) for i, x in enumerate(names)],
        # second-level numbers and first-level ones of full sequences are told apart by the lowest bit
        F.coalesce(F.col("_seq") * 2 + 1, F.col("_bin") * 2).alias("sequence_id"),
        (F.col("_at") + F.coalesce("_base", F.lit(0))).alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 0,
    whole: bool = False,
    with_ids: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document is its token ids and then `end_id`; one longer than `size` is cut into pieces of `size`, of
    which the last may be shorter. Null texts are empty ones and give the single end id. Null ids and
    repeated rows are packed like any other. An empty table gives an empty result. `tokenizer` is the path
    of a vocabulary file, which every executor must be able to open. Only the two named columns are read.
    """
    shape = "_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    pieces = cut(rows.mapInArrow(_cutter(tokenizer, whole, size, end_id, with_ids), shape))
    packed = pack(pieces.withColumnRenamed("_id", id_col), size, [id_col, "piece"], group_rows)
    return packed
