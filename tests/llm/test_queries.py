"""Registered queries against their SQL, and those without SQL against plain computations, over whole small tables."""

import hashlib
import importlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import regex

from numbra.llm import queries
from numbra.llm.simhash import simhash
from tests.llm import test_operators as T

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), duck(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    text = lambda f: sorted(f[columns].astype(object).where(f[columns].notna(), None).map(lambda x: str(int(x)) if isinstance(x, float) else str(x)).itertuples(index=False, name=None))
    assert text(got) == text(expected)


def test_op1_and_op4(spark, docs):
    T.check_spans(queries.op1_pii(spark, SF).collect(), docs, T.PII, "n_", True)
    T.check_spans(queries.op4_secrets(spark, SF).collect(), docs, T.SECRETS, "n_", False)


def test_op5_held_out(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].score.mean() > 0.8


def test_op6(spark, docs):
    got = queries.op6_pack(spark, SF).toPandas()
    assert got.groupby("doc_id").length.sum().gt(0).all() and set(got.doc_id) == set(docs)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * np.ceil(got.length.sum() / 2048)


def plain(text):
    """Words in lower case without punctuation, as op7 compares them."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [regex.sub(r"[^\p{L}\p{N}]+", "", w.lower()) or w.lower() for w in words]


def test_op7(spark, docs):
    """Over the whole table: all ways to lay all items against all documents, without seeds."""
    number = {}
    code = lambda words: np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    bench = [(r.item_id, code(plain(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(len(x) >= 8 for _, x in bench)
    expected = {}
    for d, text in docs.items():
        own, held = code(plain(text)), []
        for i, item in bench:
            need = min(13, len(item))
            at, k = np.nonzero(own[:, None] == item[None, :])
            places, count = np.unique(at - k, return_counts=True)
            for place in places[count >= np.ceil(0.8 * need)].tolist():
                lo, hi = max(0, -place), min(len(item), len(own) - place)
                same = item[lo:hi] == own[place + lo : place + hi]
                sums = np.concatenate([[0], np.cumsum(same)])
                if any((100 * (sums[b:] - sums[:-b]) >= 80 * b).any() for b in range(need, len(same) + 1)):
                    held.append(i)
                    break
        expected[d] = ",".join(map(str, sorted(held)))
    got = {r.doc_id: r.item_ids for r in queries.op7_decontaminate(spark, SF).collect()}
    assert got == expected and any(expected.values())


def test_op8(spark, docs):
    got = queries.op8_simhash(spark, SF).toPandas().set_index("doc_id").sort_index()
    prints = {i: simhash(t) for i, t in docs.items()}
    assert got.fingerprint.tolist() == [f"{prints[i]:016x}" for i in got.index]
    array, root = np.array([prints[i] for i in got.index], np.uint64), dict.fromkeys(got.index)

    def find(x):
        while root[x] is not None:
            x = root[x]
        return x

    ids = got.index.to_numpy()
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 4) + i + 1:
            a, b = sorted((find(ids[i]), find(ids[j])))
            if a != b:
                root[b] = a
    assert got.component_id.tolist() == [find(i) for i in ids]


def test_op9(spark, docs):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, SF).collect()), key=str)
    assert got == T.removed_by_force(list(docs.items()))


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    sizes = [frame.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{len(sizes)}")
        frame = spark.read.parquet(f"{tmp_path}/{len(sizes)}")
        sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert len(set(texts.values())) == len(texts)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in t for t in texts.values() for b in bench)
    pieces = pipeline.run(spark, SF).toPandas()
    assert set(pieces.doc_id) == set(texts)
    assert isinstance(pieces, pd.DataFrame) and zlib.crc32(b"") == 0 and hashlib.sha256(b"").digest_size == 32
