"""Operators on the reference fixtures' shapes, and strategies against each other."""

import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from numbra.operators import fingerprint as FP
from numbra.operators import iterative as I
from numbra.operators import linalg as L
from numbra.operators import relational as R
from numbra.operators import triage as TR
from numbra.plans import metrics, strategy
from numbra.sources import datagen, tables
from numbra.streaming import calc as SC


def test_grouped_sum_with_short_tail(spark):
    frame = spark.range(50_000).select("id", (F.col("id") * 0.5).alias("v"))
    got = {r.k: r.total for r in R.grouped_sum(frame, "id % 64", "v * 2.0D + 1.0D").collect()}
    ids = np.arange(50_000)
    for k in range(64):
        assert abs(got[k] - (ids[ids % 64 == k] + 1.0).sum()) < 1e-6


def test_sort_orders_payload_and_ties(spark):
    n = 40_009
    frame = spark.range(n).select(datagen.permuted(F.col("id"), n).alias("k"), F.col("id").alias("ordinal"), (F.col("id") * 2.0).alias("payload"))
    rows = R.sort_rows(frame, "k").collect()
    assert [r.k for r in rows] == list(range(n)) and all(r.payload == 2.0 * r.ordinal for r in rows)
    ties = R.sort_rows(frame.withColumn("k", F.col("k") % 16), "k", "ordinal").collect()
    assert [(r.k, r.ordinal) for r in ties] == sorted((r.k, r.ordinal) for r in ties)
    assert [r.k for r in R.sort_rows(frame, "k", limit=5).collect()] == [0, 1, 2, 3, 4]


def test_join_fans_out_and_drops_unmatched(spark):
    build = spark.range(20_000).select((F.col("id") % 5000).alias("k"), (F.col("id") % 5000 + 1000).alias("label"))
    probe = spark.range(10_000).select(F.col("id").alias("pk"), (F.col("id") * 0.5).alias("value"))
    for hint in (None, "merge", "shuffle_hash", "broadcast"):
        rows = R.equi_join(probe, build, "pk", "k", hint)
        assert rows.count() == 20_000
        assert rows.filter("label <> 1000 + k OR value <> k * 0.5D").count() == 0
    nulls = spark.createDataFrame([(None,)], "pk long")
    assert R.equi_join(nulls, build.unionByName(spark.createDataFrame([(None, 1)], "k long, label long")), "pk", "k").count() == 0


def test_running_total(spark):
    frame = spark.range(40_000).select(F.col("id").alias("ordinal"), (F.col("id") % 7).alias("tag"), (F.col("id") * 0.25).alias("value"))
    rows = R.running_total(frame.repartition(13), "value", "ordinal").orderBy("ordinal").collect()
    assert np.allclose([r.running for r in rows], np.cumsum(np.arange(40_000) * 0.25), atol=1e-6)
    assert R.running_total(frame.filter("false"), "value", "ordinal").count() == 0
    odd = spark.createDataFrame([(1, None), (2, 3.0), (3, None), (4, 1.0)], "o int, v double")
    assert [r.running for r in R.running_total(odd, "v", "o").orderBy("o").collect()] == [None, 3.0, 3.0, 4.0]


    more = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).cast("decimal(9,2)").alias("d"), F.col("id").cast("int").alias("i"))
    got = R.running_total(R.running_total(more, "d", "id"), "i", "id", name="sum_i").orderBy("id").collect()
    assert [int(r.running) for r in got] == list(np.cumsum([i if i % 3 == 0 else 0 for i in range(1000)])) and got[-1].sum_i == 499500
    both = R.running_total(frame, "value", "ordinal").unionByName(R.running_total(frame, "value", "ordinal"))
    assert both.groupBy("ordinal").agg(F.countDistinct("running").alias("n")).filter("n <> 1").count() == 0
    with pytest.raises(ValueError):
        R.running_total(frame.withColumnRenamed("tag", "_range"), "value", "ordinal")


def test_running_total_is_not_one_task(spark):
    frame = spark.range(1000).select("id", F.lit(1.0).alias("v"))
    out = R.running_total(frame, "v", "id")
    assert "SinglePartition" not in strategy.explain(out)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4


@pytest.mark.parametrize("d", [1, 8, 16])
def test_gram_strategies_agree(spark, d):
    x = np.random.default_rng(1).normal(size=(2000, d)) * 10.0 ** (np.arange(d) % 6)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(d)))
    names = [f"c{i}" for i in range(d)]
    a, b = (L.gram_matrix(frame, names, s).first() for s in ("catalyst", "blas"))
    expected = (x.T @ x)[np.triu_indices(d)]
    assert np.allclose(list(a), expected, rtol=1e-9) and np.allclose(list(b), expected, rtol=1e-9)
    assert a.__fields__ == b.__fields__ and L.triangle_index(d, d - 1, d - 1) == d * (d + 1) // 2 - 1
    assert all(v is None for v in L.gram_matrix(frame.filter("false"), names, "blas").first())


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")


def test_reference_join_strategies_agree(spark):
    rng = np.random.default_rng(2)
    q = vectors(spark, list(enumerate(rng.normal(size=(60, 64)))))
    refs = rng.normal(size=(90, 64))
    refs[7] = refs[3]
    r = vectors(spark, list(enumerate(refs)))
    found = [sorted((x.qid, x.rid) for x in L.reference_join(q, r, "id", "id", strategy=s).collect()) for s in ("catalyst", "blas")]
    assert found[0] == found[1] and not any(rid == 7 for _, rid in found[0])
    others = [sorted((x.qid, x.rid) for x in L.reference_join(r, r, "id", "id", strategy=s, others=True).collect()) for s in ("catalyst", "blas")]
    assert others[0] == others[1] and len(others[0]) == 90 and (3, 7) in others[0] and all(a != b for a, b in others[0])
    for key, value in (("numbra.block.rows", "7"), ("numbra.neighbour.max-pairs", "100")):
        spark.conf.set(key, value)
        assert sorted((x.qid, x.rid) for x in L.reference_join(q, r, "id", "id", strategy="blas").collect()) == found[0]
    with pytest.raises(ValueError):
        L.reference_join(q, r, "id", "id", strategy="catalyst")
    spark.conf.unset("numbra.neighbour.max-pairs")
    spark.conf.unset("numbra.block.rows")
    band = lambda f: f.withColumn("band", F.when(F.col("id") % 4 > 0, F.concat(F.lit("b"), (F.col("id") % 4).cast("string"))))
    banded = [sorted((x.qid, x.rid) for x in L.reference_join(band(q), band(r), "id", "id", strategy=s, band="band").collect()) for s in ("catalyst", "blas")]
    assert banded[0] == banded[1] and len(banded[0]) == 45 and all(a % 4 == b % 4 for a, b in banded[0])
    assert L.reference_join(q, r.filter("false"), "id", "id").count() == 0
    assert L.nearest_neighbour(q, r, "id", "id").columns == ["qid", "score"]


def test_recognisers_say_why(spark):
    assert strategy.recognise(spark, "gram", 8) == strategy.Recognition(False, "width 8 is below 17")
    assert strategy.recognise(spark, "neighbour", 64).ok and not strategy.recognise(spark, "sort", 64).ok
    for key, value in (("numbra.strategy", "catalyst"), ("numbra.enabled", "false")):
        spark.conf.set(key, value)
        assert not strategy.recognise(spark, "gram", 64).ok and strategy.choose(spark, "gram", 64) == "catalyst"
        spark.conf.unset(key)
    assert strategy.choose(spark, "gram", 64) == "blas"
    with pytest.raises(ValueError):
        strategy.choose(spark, "gram", 64, "gpu")
    guarded = strategy.recognise(spark, "gram", 64, "SIN(x) > 0.5 AND name <> 'COS(y)' OR power (a, 2) < 1")
    assert not guarded.ok and guarded.reason == "the predicate depends on POWER, SIN"
    assert strategy.recognise(spark, "gram", 64, "ABS(x) > 0.5 AND SQRT(x) < 3 AND s = 'SIN(x)'").ok
    assert "== Strategy ==\ngram: blas" in strategy.explain(spark.range(1), "gram", 32)


@pytest.mark.parametrize("how", ["catalyst", "blas"])
def test_kmeans_keeps_empty_clusters_and_first_of_ties(spark, how):
    frame = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "c0 double")
    start = [[0.0], [2.0], [50.0]]
    assert I.kmeans_train(frame, ["c0"], start, 1, how) == [[0.5], [2.0], [50.0]]
    assert I.kmeans_train(frame.filter("false"), ["c0"], start, 2, how) == start
    assert I.kmeans_assign(frame, ["c0"], start, how).first() == (3, 1.0)
    assert I.kmeans_assign(frame.filter("false"), ["c0"], start, how).first() == (0, None)


@pytest.mark.parametrize("how", ["catalyst", "blas"])
def test_logistic_regression_equals_numpy(spark, how):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(-1, 1, (500, 3)), rng.uniform(0, 1, 500)
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    w = np.zeros(3)
    for _ in range(5):
        w -= 0.1 / 500 * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y))
    assert np.allclose(I.logistic_train(frame, ["a", "b", "c"], "y", 5, strategy=how), w, atol=1e-12)
    assert I.logistic_train(frame.filter("false"), ["a", "b", "c"], "y", 2, strategy=how) == [0.0] * 3


def test_triage_note(spark):
    udf = TR.triage_udf()
    frame = spark.createDataFrame([(None,), ("",), ("machine 002: 1 x worst score 5.0, mean 1 ;; machine 001: 2 x worst score 9.0, mean 2",)], "d string")
    got = [r.n for r in frame.coalesce(1).select(udf("d").alias("n")).collect()]
    assert got[:2] == [TR.NOTHING] * 2 and got[2].startswith("@@TRIAGE engine=rules ")
    assert got[2].splitlines()[1] == "Inspect first: machine 001 (worst 9.0); machine 002 (worst 5.0);"
    assert TR.prompt(["a"]).startswith("You are a maintenance engineer.") and "\n- a\n" not in TR.INTRO


def test_server_engine_and_close(monkeypatch):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.answer({"status": "ok"})

        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer({"content": "look at 7", "tokens_evaluated": 5, "tokens_predicted": 3, "timings": {"prompt_ms": 2, "predicted_ms": 4}})

        def answer(self, what):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(what).encode())

        def log_message(self, *args):
            pass

    asked, closed = [], []
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(TR.atexit, "register", closed.append)
    try:
        make = lambda: TR.PromptServerEngine(f"http://127.0.0.1:{server.server_port}")
        engine, reused, _ = TR.resident(make)
        c = engine.generate("who?", 9)
        assert (c.text, c.prompt_tokens, c.generated_tokens, c.prefill_ns, c.decode_ns) == ("look at 7", 5, 3, 2_000_000, 4_000_000)
        assert asked == [{"prompt": "who?", "n_predict": 9, "temperature": 0}] and not reused
        assert TR.resident(make)[1] and closed == [engine.close]
        assert "generated_tokens=3 prefill_ms=2.0 decode_ms=4.0" in TR.report(engine, True, 0, 4, c)
    finally:
        server.shutdown()


def test_generators_repeat(spark):
    assert FP.canonical_rows(datagen.readings(spark, 200)) == FP.canonical_rows(datagen.readings(spark, 200).repartition(5))
    assert datagen.points(spark, 1000).filter("lat < -90 OR lat >= 90 OR lon < -180 OR lon >= 180").count() == 0
    assert datagen.keyed_events(spark, 1009).select("k").distinct().count() == 1009
    rows = datagen.conformance(spark, 30)
    assert rows.filter("n IS NULL").count() == 10 and rows.filter("c <> -(a * b)").count() == 0
    for made in (datagen.signals(spark, 5), datagen.vectors(spark, 5, 3), datagen.option_book(spark, 5)):
        assert made.count() == 5


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b", None), (2, 'q"q', 2.5)], "i int, s string, d double")
    tables.insert_into(rows, f"{tmp_path}/csv", "csv", files=1, mode="overwrite")
    back = tables.create_table(spark, "numbra_t", "i int, s string, d double", f"{tmp_path}/csv", "csv", nullValue="")
    assert FP.canonical_rows(back) == FP.canonical_rows(rows) and spark.table("numbra_t").count() == 2
    again = tables.convert(spark, f"{tmp_path}/csv", f"{tmp_path}/pq", "parquet", 2, "i int, s string, d double", "i < 2")
    assert again.count() == 1 and tables.read_parquet(spark, f"{tmp_path}/pq").dtypes == rows.dtypes
    tables.blackhole(rows)
    assert FP.differing_rows(rows, rows).count() == 0 and FP.differing_rows(rows, again).count() == 1
    assert FP.fingerprint(rows).first().i_sum == 3
    with pytest.raises(ValueError):
        tables.create_table(spark, "x", "i int", "p", "orc")


def test_streams(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 3).alias("k"), (F.col("id") * 1.0).alias("v"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = SC.stream_table(spark, f"{tmp_path}/in", rows.schema)
    q = SC.stream_calc(stream, {"id": "id", "w": "v * 2.0D + 1.0D"}, "v > 50.0D").writeStream.format("memory").queryName("numbra_calc").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.id, r.w) for r in spark.table("numbra_calc").collect()) == [(i, 2.0 * i + 1) for i in range(51, 100)]
    q = SC.windowed_sum(stream, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("numbra_sum").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("numbra_sum").agg(F.sum("n")).first()[0] == 100
    text = SC.stream_matches(stream.withColumn("s", F.col("id").cast("string")), "s", ["1", "2"])
    q = text.writeStream.format("memory").queryName("numbra_text").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("numbra_text").collect()) == [12, 21]


def test_observed_counts_rows_as_they_pass(spark):
    frame, watch = metrics.observed(spark.range(100).filter("id % 3 = 0"), "thirds", top=F.max("id"))
    tables.blackhole(frame)
    assert watch.get == {"rows": 34, "top": 99} and set(metrics.environment()) >= {"spark", "python"}


def test_dataset_crc(tmp_path):
    assert metrics.dataset_crc(str(tmp_path)) == "00000000"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x").write_bytes(b"two")
    (tmp_path / "a").write_bytes(b"one")
    first = metrics.dataset_crc(str(tmp_path))
    assert first == f"{zlib.crc32(b'aoneb/xtwo'):08x}"
    (tmp_path / "a").write_bytes(b"onf")
    assert metrics.dataset_crc(str(tmp_path)) != first
