"""Removal of repeated passages by recompression.

Every text is a string of words. A round gives names to runs and pairs of neighbouring symbols; a name is a
hash of what it stands for and a symbol's half of a pair is decided by its name, so all tasks give the same
names without asking each other, and equal passages get equal symbols except within a few words of their
ends. After two rounds a symbol stands for up to four words. Symbols that begin a sequence of five or more
words and are the least of their surroundings are the shared high-level symbols: each window of 20 words has
one that its inner words alone decide, so two equal windows share it.

  1. scan      high-level symbols, each with its document and position, dealt by symbol
  2. reveal    symbols that occur again give candidate windows, dealt by document
  3. verify    96-bit names of candidate windows, the earliest place of each stays
  4. remove    words under all later places go

Each step sends packed arrays, not rows. What a task sees twice itself is settled there: a symbol or window
goes into a shuffle once for each slice of input, however often it occurs.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import Words, cut, mix, slices, strings

#: Words of a window.
WINDOW = 20
#: A window's symbol begins at one of these words of it: the names of what comes before may depend on earlier words,
#: and the five to eight words from there end before those that may depend on later ones.
FIRST, LAST, LEAST = 4, 9, 5
_A, _B, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_ODD = mix(np.arange(101, 101 + 2 * WINDOW, dtype=np.uint64)) | np.uint64(1)
#: A null id comes last: it is packed as the largest id with positions moved by APART, which no text has words for.
_NULL, APART = np.iinfo(np.int64).max, np.int32(1 << 30)
_ROW = "bucket int, kind int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, as differences in byte planes (8-byte hashes, flagged by uint64, stay as they are)."""
    codec, out = pa.Codec("zstd", 1), [struct.pack("<IB", len(arrays[0]), len(arrays))]
    for x in arrays:
        kind = x.dtype.str[1:].encode()
        if x.dtype == np.uint64:
            raw = packed = x.tobytes()
        else:
            steps = np.diff(x, prepend=x.dtype.type(0))
            raw = steps.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
            packed = codec.compress(raw, asbytes=True)
        out += [struct.pack("<2sII", kind, len(packed), len(raw)), packed]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    codec, (n, k), at, out = pa.Codec("zstd"), struct.unpack_from("<IB", blob), 5, []
    for _ in range(k):
        kind, size, full = struct.unpack_from("<2sII", blob, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        if dtype == np.uint64:
            x = np.frombuffer(blob, dtype, n, at)
        else:
            raw = codec.decompress(blob[at : at + size], full, asbytes=True)
            steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel()
            x = np.cumsum(steps, dtype=dtype)
        out.append(x)
        at += size
    return out


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "blob"])


def _deal(bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed row for each bucket."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    arrays = [x[order] for x in arrays]
    return [(int(bucket[a]), kind, _pack(*(x[a:b] for x in arrays))) for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True)]


def _doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ _B) % np.uint64(buckets)).astype(np.int64)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and what their null ones add to positions."""
    none = pc.is_null(column).to_numpy(zero_copy_only=False)
    return pc.fill_null(column, int(_NULL)).to_numpy(zero_copy_only=False).astype(np.int64), np.where(none, APART, np.int32(0))


def _own(pos: np.ndarray, moved: int) -> np.ndarray:
    """Which positions of an id belong to a text with that id or, if moved, to one without any."""
    return (pos >= APART) == bool(moved)


def symbols(words: np.ndarray, doc: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after `rounds`; symbols do not cross documents."""
    if not len(words):
        return words, np.empty(0, np.int64)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    name, first = np.where(again, mix(words ^ _RUN), words), np.arange(len(words))
    for r in range(rounds):
        right = (mix(name ^ _ODD[r]) & np.uint64(1)).astype(bool)
        own = doc[first]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (own[:-1] == own[1:])
        at = np.flatnonzero(pair)
        name = name.copy()
        name[at] = mix(name[at] * _A + name[at + 1] * _B + _ODD[r])
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, first = name[keep], first[keep]
    return name, first


def high_symbols(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, document, position in it) of the symbols that stand for the windows of texts."""
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    name, first = symbols(words, doc)
    n = len(words)
    if n < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    # names of sequences of LEAST or more words that begin at a symbol
    own = doc[first]
    width = np.diff(first, append=n)
    total, key = width.copy(), name.copy()
    for step in range(1, LEAST):
        more = np.flatnonzero(total[: len(first) - step] < LEAST) if step < len(first) else np.empty(0, np.int64)
        more = more[own[more] == own[more + step]]
        key[more] = mix(key[more] * _A + name[more + step] * _B)
        total[more] += width[more + step]
    rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    whole = total >= LEAST
    rank[first[whole]] = key[whole] >> np.uint64(1)
    names = np.zeros(n, np.uint64)
    names[first] = key
    windows = np.flatnonzero(np.arange(n) + WINDOW <= offsets[1:][doc])
    least, at = rank[windows + FIRST], windows + FIRST
    for k in range(FIRST + 1, LAST + 1):
        lower = rank[windows + k] < least
        least = np.where(lower, rank[windows + k], least)
        at = np.where(lower, windows + k, at)
    chosen = np.zeros(n, bool)
    chosen[at] = True
    chosen = np.flatnonzero(chosen)
    return names[chosen], doc[chosen], chosen - offsets[:-1][doc[chosen]]


_SYMBOL, _HIT, _TEXT, _NAME, _GONE = 2, 0, 3, 2, 1


def _scan(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 6 << 20):
                words = Words(part.column("_text"))
                ids, moved = _ids(part.column("_id"))
                name, doc, pos = high_symbols(words.ids(), words.offsets)
                pos = pos + moved[doc]
                _, at, back, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                twice = count[back] > 1
                at = np.sort(at)
                out = _deal((name[at] % np.uint64(buckets)).astype(np.int64), _SYMBOL, name[at], ids[doc[at]], pos[at].astype(np.int32), twice[at].astype(np.int8))
                hit = np.flatnonzero(twice)
                out += _deal(_doc_bucket(ids[doc[hit]], buckets), _HIT, ids[doc[hit]], pos[hit].astype(np.int32))
                if out:
                    yield _rows(out)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Rows come sorted by bucket."""
    held, now = {}, None
    for batch in batches:
        for bucket, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now and held:
                yield now, held
                held = {}
            now = bucket
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def _concat(blobs: list[bytes] | None) -> list[np.ndarray]:
    parts = [_unpack(x) for x in blobs or []]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _reveal(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            out = [(bucket, _HIT, x) for x in held.get(_HIT, [])]
            if _SYMBOL in held:
                name, ids, pos, known = _concat(held[_SYMBOL])
                order = np.argsort(name, kind="stable")
                name = name[order]
                same = name[1:] == name[:-1]
                again = np.zeros(len(name), bool)
                again[1:] |= same
                again[:-1] |= same
                hit = np.sort(order[again])
                hit = hit[known[hit] == 0]  # the others were settled where they were seen twice
                out += _deal(_doc_bucket(ids[hit], buckets), _HIT, ids[hit], pos[hit])
            if out:
                yield _rows(out)

    return run


def _texts(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            for part in slices(batch, "_text", 6 << 20):
                ids, moved = _ids(part.column("_id"))
                bucket = _doc_bucket(ids, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                out = []
                for rows in np.split(order, cuts):
                    raw = [x.encode() for x in strings(part.column("_text")).take(pa.array(rows)).to_pylist()]
                    joined = b"".join(raw)
                    head = _pack(ids[rows], np.array([len(x) for x in raw], np.int64), moved[rows].astype(np.int32))
                    packed = codec.compress(joined, asbytes=True)
                    out.append((int(bucket[rows[0]]), _TEXT, struct.pack("<IQ", len(head), len(joined)) + head + packed))
                yield _rows(out)

    return run


def _untext(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n, full = struct.unpack_from("<IQ", blob)
    ids, lengths, moved = _unpack(blob[12 : 12 + n])
    joined = pa.Codec("zstd").decompress(blob[12 + n :], full, asbytes=True)
    ends = np.cumsum(lengths).tolist()
    return ids, moved, [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _window_names(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = mix(words + _RUN)
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        a += words[at + k] * _ODD[k]
        b += other[at + k] * _ODD[WINDOW + k]
    return mix(a), (mix(b) >> np.uint64(32)).astype(np.uint32)


def _places(ids: np.ndarray, sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(sorted_ids, ids), np.searchsorted(sorted_ids, ids, side="right")


def _earliest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one earliest place of each name, and of all places that are later than it."""
    order = np.lexsort((pos, ids, b, a))
    x, y = a[order], b[order]
    head = np.ones(len(order), bool)
    head[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    of = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    later = (ids[order] != ids[of]) | (pos[order] != pos[of])
    return np.sort(order[head]), np.sort(order[later])


def _verify(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            if _HIT not in held or _TEXT not in held:
                continue
            hit_id, hit_pos = _concat(held[_HIT])
            order = np.argsort(hit_id, kind="stable")
            hit_id, hit_pos = hit_id[order], hit_pos[order]
            found: list[list[np.ndarray]] = []
            for blob in held[_TEXT]:
                ids, moved, raw = _untext(blob)
                left, right = _places(ids, hit_id)
                some = np.flatnonzero(right > left)
                if not len(some):
                    continue
                words = Words(pa.array([raw[i] for i in some.tolist()], pa.large_binary()).cast(pa.large_string()))
                n, name = int(words.offsets[-1]), words.ids()
                marked = np.zeros(n + 1, bool)
                for k, i in enumerate(some.tolist()):
                    base, end = int(words.offsets[k]), int(words.offsets[k + 1])
                    at = hit_pos[left[i] : right[i]]
                    at = at[_own(at, moved[i])].astype(np.int64) - int(moved[i]) + base
                    for back in range(FIRST, LAST + 1):
                        start = at - back
                        marked[start[(start >= base) & (start + WINDOW <= end)]] = True
                at = np.flatnonzero(marked)
                a, b = _window_names(name, at)
                doc = np.repeat(np.arange(len(some)), np.diff(words.offsets))[at]
                found.append([a, b, ids[some][doc], (at - words.offsets[:-1][doc]).astype(np.int32) + moved[some][doc]])
            if not found:
                continue
            a, b, ids, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            first, later = _earliest(a, b, ids, pos)
            out = _deal((a[first] % np.uint64(buckets)).astype(np.int64), _NAME, a[first], b[first], ids[first], pos[first])
            if len(later):
                out.append((bucket, _GONE, _pack(ids[later], pos[later], (a[later] >> np.uint64(32)).astype(np.uint32))))
            yield _rows(out)

    return run


def _settle(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            out = [(bucket, _GONE, x) for x in held.get(_GONE, [])]
            if _NAME in held:
                a, b, ids, pos = _concat(held[_NAME])
                _, later = _earliest(a, b, ids, pos)
                out += _deal(_doc_bucket(ids[later], buckets), _GONE, ids[later], pos[later], (a[later] >> np.uint64(32)).astype(np.uint32))
            if out:
                yield _rows(out)

    return run


def _remove(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            if _TEXT not in held:
                continue
            gone = _concat(held.get(_GONE)) or [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)]
            order = np.argsort(gone[0], kind="stable")
            gone_id, gone_pos, check = (x[order] for x in gone)
            every = np.concatenate([_unpack(x[12 : 12 + struct.unpack_from("<I", x)[0]])[0] for x in held[_TEXT]])
            names, counts = np.unique(every, return_counts=True)
            shared = set(names[counts > 1].tolist())
            for blob in held[_TEXT]:  # one packed slice of texts at a time
                ids, moved, raw = _untext(blob)
                left, right = _places(ids, gone_id)
                out = []
                for i, (d, text) in enumerate(zip(ids.tolist(), raw, strict=True)):
                    words = text.split()
                    n = len(words)
                    at = gone_pos[left[i] : right[i]]
                    own = _own(at, moved[i])
                    if own.any():
                        at, sign = at[own].astype(np.int64) - int(moved[i]), check[left[i] : right[i]][own]
                        if d in shared:  # places of another row with this id have other names
                            inside = at + WINDOW <= n
                            at, sign = at[inside], sign[inside]
                            a, _ = _window_names(Words(pa.array([text], pa.large_binary()).cast(pa.large_string())).ids(), at)
                            at = at[(a >> np.uint64(32)).astype(np.uint32) == sign]
                        over = np.zeros(n + 1, np.int64)
                        np.add.at(over, at, 1)
                        np.add.at(over, at + WINDOW, -1)
                        words = list(compress(words, (np.cumsum(over)[:n] == 0).tolist()))
                    kept = b" ".join(words)
                    out.append((None if moved[i] else d, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out])]
                if with_text:
                    columns.append(pa.array([x[4] for x in out], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (and kept_text, if asked for).

    A word goes if a window of 20 words of its text covers it whose words also stand, in order, earlier: in a
    text of a smaller id, or earlier in the same text. Windows are judged on the texts as they came. Null
    texts have no words. A null id comes after all others. Rows that share an id are one document whose
    places are told apart by their starts alone, so a row that repeats id and text gets the same result and
    does not remove its twin. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # a packed row goes from each slice to each bucket, so buckets are no more than there are tasks to read them
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    hits = cut(dealt(rows.mapInArrow(_scan(buckets), _ROW)).mapInArrow(_reveal(buckets), _ROW))
    texts = rows.mapInArrow(_texts(buckets), _ROW)
    names = dealt(texts.unionByName(hits)).mapInArrow(_verify(buckets), _ROW)
    gone = cut(dealt(names).mapInArrow(_settle(buckets), _ROW))
    shape = "_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt(texts.unionByName(gone)).mapInArrow(_remove(with_text), shape).withColumnRenamed("_id", id_col)
