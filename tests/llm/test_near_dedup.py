"""The pipeline's near-dedup stage against brute force."""

import random

import corpus_pipeline
from numbra.llm.near_dedup import near_components
from tests.llm.test_operators import documents


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def representatives(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def test_blocks_of_a_group_meet(spark):
    """Texts of one group that no star holds together, dealt to blocks of two: the same components as in one block."""
    rng = random.Random(5)
    words, texts = [f"w{i}" for i in range(120)], []
    for _ in range(24):
        texts.append(" ".join(words))
        for _ in range(2):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_node long, _text string")
    found = {r.node: r.root for r in near_components(rows, block=2).collect()}
    want = representatives(texts)
    assert len({found.get(i, i) for i in range(len(texts))}) == len(want)
    assert len(want) < 6


def test_near_copies_by_similarity(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "One TWO", "one two three"]
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))]
        for k in range(4):  # chains: each text differs from the one before by words spread over it
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // (40 + 20 * k))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    rng.shuffle(texts)
    want = representatives(texts)
    assert 40 <= len(want) < len(texts) - 60
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, [*texts, "without id"], [*range(len(texts)), None]), "")
    assert got.columns == documents(spark).columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([*want, None], key=str)
    assert corpus_pipeline.drop_near_copies(spark, documents(spark).filter("false"), "").count() == 0
