"""Toxicity against brute force, and on texts whose clean words lean towards the toxic class."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from numbra.llm.common import Words
from numbra.llm.toxicity import _BIN, LEAST_DOCUMENTS, LEAST_TOKENS, LEAST_Z, LENGTHS, PRIOR, TOLLS, _best, _features, _word_scores, fit_toxicity, maximal_segments, toxicity

RNG = random.Random(11)


def learnt(k):
    return zlib.crc32(str(k).encode()) % 5 != 0


def tables(spark, texts, marks):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")


def mixed(k, bad=("idiot", "idiotic", "scumbag", "scumbags", "moron")):
    words = [RNG.choice(["river", "rivers", "stone", "stoned", "cloud", "it", "meadow", "meadows"]) for _ in range(RNG.randrange(15, 50))]
    if k % 4 == 0 or k % 9 == 1:  # some clean texts have one, too
        for _ in range(4 if k % 4 == 0 else 1):
            words[RNG.randrange(len(words))] = RNG.choice(bad)
    return " ".join(words)


def plain_scores(texts, marks):
    """(score of each word, clean tokens by their score) by nested loops over all learnt texts."""
    of = lambda w: [w[:k] if k else f"{w}$" for k in LENGTHS if not k or len(w) >= k]
    tokens, docs, sums, held = defaultdict(Counter), defaultdict(Counter), Counter(), Counter()
    for k, (text, y) in enumerate(zip(texts, marks, strict=True)):
        if learnt(k):
            sums[y] += len(text.split())
            held[y] += 1
            for w in text.split():
                tokens[y].update(of(w))
            docs[y].update({f for w in text.split() for f in of(w)})
    counted = {f for f in tokens[1] if tokens[1][f] >= LEAST_TOKENS and docs[1][f] >= LEAST_DOCUMENTS}
    above = {f: g for w in {w for t in texts for w in t.split()} for g, f in zip(of(w), of(w)[1:], strict=False)}
    score, share = {}, sums[1] / (sums[0] + sums[1])
    for f in counted:
        g = above.get(f)
        mean = (tokens[1][g] + share) / (tokens[1][g] + tokens[0][g] + 1) if g in counted else share
        s = math.log((tokens[1][f] + PRIOR * mean) / sums[1]) - math.log((tokens[0][f] + PRIOR * (1 - mean)) / sums[0])
        a, b = docs[1][f] + 0.5, docs[0][f] + 0.5
        c, d = held[1] - docs[1][f] + 0.5, held[0] - docs[0][f] + 0.5
        z = (math.log(a / c) - math.log(b / d)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        if abs(z) >= LEAST_Z and z * s > 0:
            score[f] = s
    last = lambda w: next((f for f in reversed(of(w)) if f in score), None)
    own = Counter(), Counter()
    for k, (text, y) in enumerate(zip(texts, marks, strict=True)):
        if learnt(k):
            own[y].update(f for w in text.split() if (f := last(w)))
    rest = min(-0.05, math.log((1 - min(0.95, own[1].total() / sums[1])) / (1 - min(0.95, own[0].total() / sums[0]))))
    spread = Counter({None: sums[0] - own[0].total()}) + own[0]
    return (lambda w: score.get(last(w), rest)), [(score.get(f, rest), n) for f, n in spread.items()]


def test_scores_by_brute_force(spark):
    texts = [mixed(k) for k in range(240)]
    marks = [int(k % 4 == 0) for k in range(240)]
    docs, labels = tables(spark, texts, marks)
    model = fit_toxicity(docs, labels)
    word, clean = plain_scores(texts, marks)
    values = pa.array(sorted({w for t in texts for w in t.split()}))
    got = _word_scores(model, Words(pa.array([" ".join(values.to_pylist())])))
    want = np.array([word(w) for w in values.to_pylist()])
    toll = want[0] - got[0]
    assert min(abs(toll - x) for x in TOLLS) < 1e-9 and np.allclose(want - toll, got)
    # the rate is the root of its equation over the clean tokens
    assert sum(n * math.exp(model.rate * (s - toll)) for s, n in clean) == pytest.approx(sum(n for _, n in clean), rel=1e-6)
    rows = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    for k, text in enumerate(texts):
        own = [word(w) - toll for w in text.split()]
        best = max(0.0, *(sum(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)))
        x = model.rate * best - model.log_k - math.log(len(own)) if best > 0 else -20.0
        assert rows[k].score == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.shift))), abs=1e-9)


def test_best_segment_is_the_best_of_all_segments(spark):
    texts = [mixed(k) for k in range(120)]
    docs, labels = tables(spark, texts, [int(k % 4 == 0) for k in range(120)])
    model = fit_toxicity(docs, labels)
    texts += [None, "", "  "]
    marks = [int(k % 4 == 0) for k in range(len(texts))]
    rates = [0.5 + k for k in range(len(TOLLS))]
    held = type("Held", (), {"value": model})
    found = Counter()
    for batch in _best(held, rates)(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(marks, pa.int32())], ["_text", "_toxic"])])):
        for r in batch.to_pylist():
            found[r["toxic"], r["toll"], r["bin"]] += r["texts"]
    want = Counter()
    for text, y in zip(texts, marks, strict=True):
        words = (text or "").split()
        own = [float(_word_scores(model, Words(pa.array([w])))[0]) for w in words]
        for k, toll in enumerate(TOLLS):
            best = max((s for _, _, s in maximal_segments([x - toll for x in own])), default=0.0)
            value = rates[k] * best - math.log(len(words)) if best > 0 else -20.0
            want[y, k, min(2000, max(-40, round(value / _BIN)))] += 1
    assert found == want


def test_clean_words_that_lean_to_the_toxic_class(spark):
    """In one of two languages half of the texts are toxic, so all of its words have positive log-odds: its long
    clean texts must be left alone, and short toxic passages be caught in either language."""
    rng = random.Random(3)
    vocabularies = [[f"{a}{b}" for a in "tkpsmn" for b in ends] for ends in (["alo", "emi", "uro", "ina"], ["ght", "rst", "nch", "lds"])]
    texts, marks = [], []
    for k in range(600):
        language = k % 2
        toxic = rng.random() < (0.5 if language else 0.02)
        words = [rng.choice(vocabularies[language]) for _ in range(rng.choice([60, 150, 1500]))]
        if toxic:
            at = rng.randrange(len(words) - 8)
            words[at : at + 8] = [rng.choice(["vileword", "slurword", "grimword"]) if rng.random() < 0.6 else w for w in words[at : at + 8]]
        texts.append(" ".join(words))
        marks.append(int(toxic and any("word" in w for w in words)))
    rows = toxicity(*tables(spark, texts, marks)).collect()
    wrong = [r.doc_id for r in rows if r.predicted != marks[r.doc_id]]
    assert len(wrong) <= 6
    assert _features(pa.array(["", "--", "Ab"]))[0].tolist() == [0, 0, 0]
