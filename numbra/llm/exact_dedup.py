"""Exact deduplication with Patricia tries.

Texts are dealt to partitions by byte length and content hash. Every partition holds one compressed
radix trie of full byte strings; a terminal node stores the owner's id and the number of rows. A trie
over its memory budget spills whole subtrees to a private temporary file and settles each of them on
its own afterwards. The same trie runs before the shuffle, so a text that fills a third of all rows
crosses the network once for each input partition.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of edge labels that a trie holds before it spills a subtree.
TRIE_BYTES = 192 << 20
OUT_BYTES = 4 << 20

_HEAD = struct.Struct("<I?qqI")


class _Node:
    __slots__ = ("label", "kids", "owner", "rows", "tag", "file")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.rows, self.tag, self.file = label, None, None, 0, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    step = 32
    while low + step < high and a[low : low + step] == b[at + low : at + low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with an owner id (by `choose`, nulls lose), a row count and a tag each."""

    def __init__(self, choose: Callable = max, budget: int = TRIE_BYTES):
        self.root, self.choose, self.budget, self.held, self.spills = _Node(b""), choose, budget, 0, 0

    def add(self, key: bytes, owner: int | None, rows: int, tag: bytes) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                self._write(node.file, key[at:], owner, rows, tag)
                return
            if at == len(key):
                break
            if node.kids is None:
                node.kids = {}
            child = node.kids.get(key[at])
            if child is None:
                child = node.kids[key[at]] = _Node(key[at:])
                self.held += len(child.label) + 200
                node = child
                break
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            k = _common(child.label, key, at)
            upper = _Node(child.label[:k])
            child.label = child.label[k:]
            upper.kids = {child.label[0]: child}
            node.kids[key[at]] = upper
            self.held += 200
            node, at = upper, at + k
        if node.rows == 0:
            node.owner, node.tag = owner, tag
        elif owner is not None:
            node.owner = owner if node.owner is None else self.choose(node.owner, owner)
        node.rows += rows
        if self.held > self.budget:
            self._spill()

    @staticmethod
    def _write(file, rest: bytes, owner: int | None, rows: int, tag: bytes) -> None:
        file.write(_HEAD.pack(len(rest), owner is None, owner or 0, rows, len(tag)) + tag)
        file.write(rest)

    @staticmethod
    def _weight(node: _Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + 200
            todo.extend((x.kids or {}).values())
        return total

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int, bytes]]:
        todo = [(node, prefix)]
        while todo:
            x, before = todo.pop()
            here = before + x.label
            if x.rows:
                yield here, x.owner, x.rows, x.tag
            if x.file is None:
                todo.extend((y, here) for y in (x.kids or {}).values())
            else:
                x.file.flush()
                x.file.seek(0)
                inner = PatriciaTrie(self.choose, self.budget)
                while head := x.file.read(_HEAD.size):
                    n, missing, owner, rows, m = _HEAD.unpack(head)
                    tag = x.file.read(m)
                    inner.add(x.file.read(n), None if missing else owner, rows, tag)
                for rest, owner, rows, tag in inner._walk(inner.root, b""):
                    yield here + rest, owner, rows, tag
                x.file.close()

    def _spill(self) -> None:
        """Moves the heaviest subtree below the topmost branching node to a file."""
        top = self.root
        while len(kids := [x for x in (top.kids or {}).values() if x.file is None]) == 1:
            top = kids[0]
        if not kids:  # one string is all there is to hold
            return
        node = max(kids, key=self._weight)
        freed = self._weight(node)
        file = tempfile.TemporaryFile(buffering=1 << 20)
        kept = node.label[:1]
        for key, owner, rows, tag in self._walk(node, b""):
            self._write(file, key[1:], owner, rows, tag)
        node.label, node.kids, node.owner, node.rows, node.tag, node.file = kept, None, None, 0, None, file
        self.held -= freed - 201
        self.spills += 1

    def items(self) -> Iterator[tuple[bytes, int | None, int, bytes]]:
        """(key, owner, rows, tag) of every distinct string."""
        return self._walk(self.root, b"")


def _settle(with_text: bool, keep: str, budget: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(max if keep == "max" else min, budget)
        for batch in batches:
            names = ("_text", "_sha", "_owner", "_rows")
            text, sha, owner, rows = (batch.column(x) for x in names)
            text = text.cast(pa.large_binary())
            for t, s, o, r in zip(text, sha.to_pylist(), owner.to_pylist(), rows.to_pylist(), strict=True):
                trie.add(t.as_py(), o, r, s)
        out, size = [], 0

        def batch_of(out: list) -> pa.RecordBatch:
            columns = [
                pa.array([x[3] for x in out], pa.binary()),
                pa.array([len(x[0]) for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.int64()),
            ]
            names = ["_sha", "_bytes", "_owner", "_rows"]
            if with_text:
                columns.append(pa.array([x[0] for x in out], pa.binary()))
                names.append("_text")
            return pa.RecordBatch.from_arrays(columns, names)

        for item in trie.items():
            out.append(item if with_text else (range(len(item[0])), *item[1:]))
            size += 100 + len(item[0]) * with_text
            if size > OUT_BYTES:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return run


def _owners(rows: DataFrame, keep: str, trie_bytes: int) -> DataFrame:
    """(_sha, _bytes, keep_id, group_size) of the distinct texts of rows (_owner, _text, _sha)."""
    shape = "_sha binary, _bytes long, _owner long, _rows long"
    return (
        rows.select("_owner", "_text", "_sha", F.lit(1).cast("long").alias("_rows"))
        .mapInArrow(_settle(True, keep, trie_bytes), f"{shape}, _text binary")
        .repartition("_bytes", "_sha")
        .mapInArrow(_settle(False, keep, trie_bytes), shape)
        .select("_sha", "_bytes", F.col("_owner").alias("keep_id"), F.col("_rows").alias("group_size"))
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    normalise: Callable[[Column], Column] | None = None,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256.

    Equal means byte-equal after `normalise` (none by default). `keep` is "max" or "min": which id of a
    group stays. Null texts equal the empty text. A null id never owns a group that has another id; a
    group of null ids has a null keep_id and all of its rows are kept. Rows that repeat both id and text
    are copies of one document and carry the same decision. An empty table gives an empty result. Only
    the two named columns are read, so other columns may have any name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("_owner"), text.cast("binary").alias("_text"))
    rows = rows.select("_owner", "_text", F.unhex(F.sha2("_text", 256)).alias("_sha"))
    owners = _owners(rows, keep, trie_bytes)
    members = rows.select(F.col("_owner").alias(id_col), "_sha", F.octet_length("_text").cast("long").alias("_bytes"))
    return members.join(owners, ["_sha", "_bytes"]).select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows that exact_dedup() keeps, with all their columns; one of those that repeat id and text.

    The row that stays is told by id and content hash, so the join brings at most one row of each group, hot or
    not, to a kept one. Names that begin with `_keep_` must not be columns of docs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    number = F.col(id_col).cast("long")
    rows = docs.select(number.alias("_owner"), text.alias("_text")).withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    kept = _owners(rows, keep, trie_bytes).select(F.col("_sha").alias("_keep_key"), F.col("keep_id").alias("_keep_id"))
    keys = lambda sha, n: {"_keep_sha": sha, "_keep_number": F.coalesce(n, F.lit(0)), "_keep_none": n.isNull()}
    named = docs.withColumns(keys(F.unhex(F.sha2(text, 256)), number))
    kept = kept.select(*(c.alias(n) for n, c in keys(F.col("_keep_key"), F.col("_keep_id")).items()))
    # plain equalities, so the join's partitioning serves the last step too; a kept text has one id
    joined = named.join(kept, ["_keep_sha", "_keep_number", "_keep_none"], "left_semi")
    return joined.dropDuplicates(["_keep_sha", "_keep_number", "_keep_none"]).select(*docs.columns)
