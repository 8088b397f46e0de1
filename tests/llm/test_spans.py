"""Scans of very long texts, and what the learnt spans find and leave alone."""

import random
import string

import pytest

from numbra.llm import pii, secrets
from tests.llm import test_operators as T


def test_very_long_texts(spark):
    texts = ["a@b" + ".c.dd" * 20_000, "7 " * 200_000, "x12345 " * 50_000, "a@b.cc 1.2.3.4 " * 10_000, "+" * 100_000 + "!" * 100_000 + "@", "!" * 200_000 + "a1"]
    T.check_spans(pii.find_pii(T.documents(spark, texts)).collect(), texts, T.PII, "n_", True)
    texts = ["token=abcdef12 deadbeefdeadbeefdeadbeef00 aZ9kQ2mmX81qqWe " * 10_000, "token" + " " * 200_000, "a1" * 200_000]
    T.check_spans(secrets.find_secrets(T.documents(spark, texts)).collect(), texts, T.SECRETS, "n_", False)


def test_learnt_personal_data(spark):
    """Numbers of a shape of their own behind words that phones teach; the same shape behind other words stays."""
    r = random.Random(3)
    filler = ["station", "reading", "river", "garden", "window"]
    some = lambda: " ".join(r.choice(filler) for _ in range(r.randrange(3, 12)))
    odd = lambda: f"0{r.randrange(100, 999)}/{r.randrange(100, 999)} {r.randrange(1000, 9999)}"
    texts, unseen = [], set()
    for k in range(480):
        label = r.choice(["phone:", "Call", "tel:"])
        if k % 8 not in (1, 2, 5):
            texts.append(f"{some()} {label} +1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}, {some()}")
        elif k % 8 == 1:
            texts.append(f"{some()} {label} {odd()} {some()}" if k % 3 else f"{some()} tel:0{r.randrange(10**6, 10**7)}. {some()}")
            unseen.add(k)
        else:
            texts.append(f"{some()} {r.choice(['invoice', 'edition', 'of'])} {odd()} {some()}")
    found = {x.doc_id for x in pii.find_pii(T.documents(spark, texts)).collect() if "like_phone" in x.spans}
    assert len(found & unseen) >= 0.9 * len(unseen) and len(found & unseen) >= 0.95 * len(found)


@pytest.mark.parametrize("length", [12, 16, 20, 32])
def test_random_strings_by_length(spark, length):
    r = random.Random(length)
    words = "station reading thousand management understanding version update server release number".split()
    ordinary = [" ".join(r.choice(words) for _ in range(60)) for _ in range(60)]
    random_ones = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(length - 2)) + "7Q" for _ in range(150)]
    plain = [f"{r.choice(words)}_{r.choice(words)}_{r.randrange(3000)}" for _ in range(150)]
    texts = ordinary + [f"see {x} here" for x in random_ones + plain]
    hit = [("markov" in x.spans) for x in sorted(secrets.find_secrets(T.documents(spark, texts)).collect(), key=lambda x: x.doc_id)]
    assert sum(hit[60:210]) >= 0.9 * 150
    assert sum(hit[210:]) == 0 and sum(hit[:60]) == 0
