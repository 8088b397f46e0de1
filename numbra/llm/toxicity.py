"""Toxic passages by maximum-scoring segments.

Every token has a log-odds between toxic and clean text, of the word or else its longest telling prefix, with
Dirichlet priors that lean each feature on the next shorter one. A linear scan lists all maximal scoring segments of a document. Segment scores are turned into
expected numbers of chance segments of that score in a text of that length (extreme-value statistics of the
clean training texts), and a logistic curve over the best one gives the document's score. These statistics
hold only if scores fall along every kind of clean text; so each token also pays a toll, and of a few tolls
the one whose curve fits the training labels best is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import Words, cut, slices

#: The classifier is fitted on about this many labelled rows at most (all of them, if there are fewer).
MOST_LABELLED = 200_000
#: Features that the driver and the counting tasks hold at once; more of them are handled in several blocks.
MOST_FEATURES = 200_000
#: Pseudo-tokens of the Dirichlet prior; least toxic tokens and documents of a feature; its least z by documents.
PRIOR, LEAST_TOKENS, LEAST_DOCUMENTS, LEAST_Z = 4.0, 4, 3, 3.0
#: Features of a word, shortest first; 0: the whole word.
LENGTHS = (4, 5, 6, 7, 0)
#: A passage is significant if fewer than this many of its score are expected in a clean text of that length.
SIGNIFICANT = 0.05
#: Tolls of a token that the fit chooses from.
TOLLS = (0.0, 0.25, 0.5, 1.0, 2.0)
_BIN = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    """Token scores by feature hash, the score of all other tokens, and the calibration."""

    hashes: np.ndarray
    scores: np.ndarray
    other: float
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def surprise(self, best: float, words: int) -> float:
        """-ln of the expected number of chance segments with this score; large: no chance segment."""
        return self.rate * best - self.log_k - math.log(max(words, 1)) if best > 0 else -20.0

    def probability(self, surprise: float) -> float:
        x = self.slope * surprise + self.shift
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _features(values: pa.Array) -> list[np.ndarray]:
    """Hashes of each distinct word's prefixes of LENGTHS and of the word; 0 where it is shorter or has no letter or digit."""
    bare = pc.utf8_lower(pc.replace_substring_regex(values, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).to_pylist()
    of = xxhash.xxh64_intdigest
    out = []
    for k in LENGTHS:
        found = (of(x[:k], k) if len(x) >= k else 0 for x in bare) if k else (of(x) if x else 0 for x in bare)
        out.append(np.fromiter(found, np.uint64, len(bare)))
    return out


def _counter(wanted) -> Callable:
    """(feature, above, top, tokens, docs) of all features of the texts, or of those in the sorted array `wanted`; `above`: the next shorter one, `top`: the shortest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 8 << 20):
                words = Words(part.column("_text"))
                n = len(words.values)
                if not n:
                    continue
                tokens = np.bincount(words.codes, minlength=n)
                pairs = np.unique(np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets)) * n + words.codes)
                above, top = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for of in _features(words.values):
                    use = of > 0
                    top = np.where(top > 0, top, of)
                    if wanted is not None:
                        w = wanted.value
                        use &= w[np.minimum(np.searchsorted(w, of), len(w) - 1)] == of
                    if use.any():
                        named, first, at = np.unique(of[use], return_index=True, return_inverse=True)
                        index = np.full(n, -1)
                        index[use] = at
                        mine = pairs[index[pairs % n] >= 0]
                        docs = np.unique(mine // n * len(named) + index[mine % n]) % len(named)
                        columns = [named.view(np.int64), above[use][first].view(np.int64), top[use][first].view(np.int64)]
                        columns += [np.bincount(at, tokens[use], len(named)).astype(np.int64), np.bincount(docs, minlength=len(named))]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["feature", "above", "top", "tokens", "docs"])
                    above = np.where(of > 0, of, above)

    return run


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one linear scan; end is exclusive.

    Each segment has a positive score that no shorter or longer overlapping one beats, and they are disjoint.
    """
    found: list[list] = []  # start, end, cumulative score before and after, index of the last with less before it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def _word_scores(model: ToxicityModel, words: Words) -> np.ndarray:
    """The score of each distinct word."""
    table = np.full(len(words.values), model.other)
    if len(model.hashes):
        for of in _features(words.values):  # the longest one has the last say
            at = np.minimum(np.searchsorted(model.hashes, of), len(model.hashes) - 1)
            hit = (model.hashes[at] == of) & (of > 0)
            table[hit] = model.scores[at[hit]]
    return table


def passages(model: ToxicityModel, words: Words) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """(words, maximal segments) of each text."""
    table = _word_scores(model, words)
    scores = table[words.codes] if len(table) else np.empty(0)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        own = scores[a:b]
        up = np.flatnonzero(own > 0)
        if not len(up):
            out.append((b - a, []))
            continue
        # only the rises and the sums between them matter
        sums = np.concatenate([[0.0], np.cumsum(own)])
        short = [float(own[up[0]])]
        for i, j in zip(up[:-1].tolist(), up[1:].tolist(), strict=True):
            short += [float(sums[j] - sums[i + 1]), float(own[j])]
        out.append((b - a, [(int(up[x // 2]), int(up[(y - 1) // 2]) + 1, s) for x, y, s in maximal_segments(short)]))
    return out


def _best(held, rates: list[float]) -> Callable:
    """(toxic, toll, bin, texts): texts by their best segment's rate * score - ln(words) in bins of _BIN, for each toll.

    The best segment alone needs no list of segments: it is the largest rise of the running sum over its least value before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in slices(batch, "_text", 8 << 20):
                words = Words(part.column("_text"))
                lengths = np.diff(words.offsets)
                scores = _word_scores(model, words)[words.codes] if len(words.values) else np.empty(0)
                best = np.zeros((len(lengths), len(TOLLS)))
                for i, (a, n) in enumerate(zip(words.offsets.tolist(), lengths.tolist())):  # noqa: B905
                    sums = np.concatenate([[0.0], np.cumsum(scores[a : a + n])])
                    for k, toll in enumerate(TOLLS):
                        paid = sums - toll * np.arange(n + 1)
                        best[i, k] = (paid - np.minimum.accumulate(paid)).max()
                value = np.where(best > 0, best * rates - np.log(np.maximum(lengths, 1))[:, None], -20.0)
                bins = np.clip(np.round(value / _BIN), -40, 2000).astype(np.int64)
                toxic = (part.column("_toxic").to_numpy(zero_copy_only=False) == 1).astype(np.int64)
                each = np.stack([np.repeat(toxic, len(TOLLS)), np.tile(np.arange(len(TOLLS)), len(toxic)), bins.ravel()])
                rows, count = np.unique(each, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, count)], ["toxic", "toll", "bin", "texts"])

    return run


def _token_scores(table: dict[str, np.ndarray], sums: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, log-odds and counts of toxic and clean tokens of the telling ones, in order of the features.

    A token counts for the longest of its telling features, which has its score."""
    order = np.argsort(table["feature"])
    t = {k: x[order] for k, x in table.items()}
    share = sums["t"] / (sums["t"] + sums["c"])
    # the prior leans on the next shorter feature, if that was counted
    up = np.minimum(np.searchsorted(t["feature"], t["above"]), len(order) - 1)
    known = t["feature"][up] == t["above"]
    mean = np.where(known, (t["toxic"][up] + share) / (t["toxic"][up] + t["clean"][up] + 1), share)
    score = np.log((t["toxic"] + PRIOR * mean) / sums["t"]) - np.log((t["clean"] + PRIOR * (1 - mean)) / sums["c"])
    cells = [t["toxic_docs"] + 0.5, sums["td"] - t["toxic_docs"] + 0.5, t["clean_docs"] + 0.5, sums["cd"] - t["clean_docs"] + 0.5]
    z = (np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])) / np.sqrt(sum(1 / x for x in cells))
    keep = (np.abs(z) >= LEAST_Z) & (z * score > 0)
    own = {name: t[name].astype(float) for name in ("toxic", "clean")}
    mine = np.flatnonzero(keep)
    at, linked = up[mine], known[mine]
    for _ in LENGTHS:  # up to the next shorter telling one
        on = linked & ~keep[at]
        linked = np.where(on, known[at], linked)
        at = np.where(on, up[at], at)
    for name, count in own.items():
        np.subtract.at(count, at[linked], t[name][mine[linked]])
    return t["feature"][keep], score[keep], own["toxic"][keep], own["clean"][keep]


def _rate(scores: np.ndarray, tokens: np.ndarray) -> float:
    """The rate that solves E[exp(rate * score)] = 1 over tokens with these scores and counts."""
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        total = (tokens * np.exp(np.minimum(mid * scores, 50))).sum()
        low, high = (mid, high) if total < tokens.sum() else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a weak prior that keeps separable classes finite."""
    a, b = 0.5, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.5 * (a - 0.5), (weight * (p - y)).sum() + 0.5 * (b + 1.0)])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.5]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = max(0.01, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    most_labelled: int = MOST_LABELLED,
    most_features: int = MOST_FEATURES,
) -> ToxicityModel:
    """A model from the labelled documents whose crc32(id as text) mod 5 is not 0.

    Null ids and null labels teach nothing; of several labels of an id the largest counts. Without any toxic
    or any clean example the model finds nothing.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(toxic_col).cast("int").alias("_toxic")).dropna()
    known = known.filter(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)) != 0).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    n = known.count()
    if n > most_labelled:  # a share by hash
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most_labelled / n))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # about most_labelled rows of two numbers
    rows = rows.join(F.broadcast(known), "_id").select("_text", "_toxic")
    spark, shape = docs.sparkSession, "feature long, above long, top long, tokens long, docs long"

    def counted(frame: DataFrame, wanted) -> DataFrame:
        found = frame.select("_text").mapInArrow(_counter(wanted), shape)
        # what the caller does not select is not shuffled
        return found.groupBy("feature").agg(F.max("above").alias("above"), F.max("top").alias("top"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))

    words = F.size(F.split(F.trim(F.coalesce("_text", F.lit(""))), r"\s+"))
    totals = {r["t"]: r for r in rows.groupBy((F.col("_toxic") == 1).alias("t")).agg(F.sum(words).alias("n"), F.count("*").alias("d")).collect()}
    nothing = ToxicityModel(np.empty(0, np.uint64), np.empty(0), -1.0, shift=-20.0)
    if len(totals) < 2:
        return nothing
    toxic = counted(rows.filter("_toxic = 1"), None).filter((F.col("tokens") >= LEAST_TOKENS) & (F.col("docs") >= LEAST_DOCUMENTS))
    toxic = cut(toxic)
    # features of one shortest prefix stay together, since priors lean on shorter ones
    blocks = max(1, math.ceil(toxic.count() / most_features))
    of = lambda found, name: found.column(name).to_numpy()
    sums = {"t": totals[True]["n"], "c": totals[False]["n"], "td": totals[True]["d"], "cd": totals[False]["d"]}
    telling = []
    for k in range(blocks):
        # five numbers for each of about most_features rows, as arrays
        mine = toxic.filter(F.pmod(F.xxhash64("top"), F.lit(blocks)) == k).select("feature", "above", "tokens", "docs").toArrow()
        if not mine.num_rows:
            continue
        feature = of(mine, "feature").view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(feature))
        clean = counted(rows.filter("_toxic <> 1"), wanted).select("feature", "tokens", "docs").toArrow()
        order = np.argsort(feature)
        at = order[np.searchsorted(feature[order], of(clean, "feature").view(np.uint64))]
        table = {"feature": feature, "above": of(mine, "above").view(np.uint64), "toxic": of(mine, "tokens"), "toxic_docs": of(mine, "docs")}
        for name, source in (("clean", "tokens"), ("clean_docs", "docs")):
            table[name] = np.zeros(len(feature), np.int64)
            table[name][at] = of(clean, source)
        telling.append(_token_scores(table, sums))
        wanted.unpersist()
    if not telling:
        return nothing
    hashes, scores, tox, cln = (np.concatenate(x) for x in zip(*telling, strict=True))
    order = np.argsort(hashes)
    hashes, scores, tox, cln = hashes[order], scores[order], tox[order], cln[order]
    # words outside of the model: what the telling features leave of either class
    t, c = (min(0.95, x.sum() / n) for x, n in ((tox, sums["t"]), (cln, sums["c"])))
    other = min(-0.05, math.log((1 - t) / (1 - c)))
    clean_scores, clean_tokens = np.append(scores, other), np.append(cln, max(1.0, sums["c"] - cln.sum()))
    rates = [_rate(clean_scores - toll, clean_tokens) for toll in TOLLS]
    held = spark.sparkContext.broadcast(ToxicityModel(hashes, scores, other))
    # a table of bins, whatever the number of rows
    bins = rows.mapInArrow(_best(held, rates), "toxic long, toll long, bin long, texts long").groupBy("toxic", "toll", "bin").agg(F.sum("texts").alias("texts")).collect()
    held.unpersist()
    fits = []
    for k, toll in enumerate(TOLLS):
        mine = [r for r in bins if r["toll"] == k]
        x, y, w = (np.array([float(r[name]) for r in mine]) for name in ("bin", "toxic", "texts"))
        x = x * _BIN
        chance = (y == 0) & (x > -20)
        # for a Gumbel variable the mean of rate * best - ln(words) is ln K + Euler's constant
        log_k = float((x[chance] * w[chance]).sum() / w[chance].sum() - 0.5772) if chance.any() else 0.0
        x = np.where(x > -20, x - log_k, -20.0)
        slope, shift = _logistic(x, y, w)
        loss = float((w * np.logaddexp(0, np.where(y == 1, -1, 1) * (slope * x + shift))).sum())
        fits.append((loss, ToxicityModel(hashes, scores - toll, other - toll, rates[k], log_k, slope, shift)))
    return min(fits, key=lambda f: f[0])[1]


def _score(model, id_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "_text", 8 << 20):
                score, spans = [], []
                for n, found in passages(m, Words(part.column("_text"))):
                    score.append(m.probability(m.surprise(max((s for _, _, s in found), default=0.0), n)))
                    rated = [(a, b, s, math.exp(min(50.0, -m.surprise(s, n)))) for a, b, s in found]
                    spans.append([dict(zip(("start", "end", "score", "expected"), x, strict=True)) for x in rated if x[3] < SIGNIFICANT])
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in part.schema.names), pa.array(score, pa.float64()), pa.array(spans, span)], [*part.schema.names, "_score", "_passages"])

    return run


def score_rows(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Adds _score (0 to 1) and _passages (word spans, exclusive ends) to rows that keep all their columns.

    Null and empty texts have no passage. No input column may be called _text, _score or _passages.
    """
    if clash := {"_text", "_score", "_passages"} & set(docs.columns):
        raise ValueError(f"columns are called {clash}")
    held = docs.sparkSession.sparkContext.broadcast(model)  # scores of the telling features only
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shape += ", _score double, _passages array<struct<start: int, end: int, score: double, expected: double>>"
    text = docs.withColumnRenamed(text_col, "_text")
    return text.mapInArrow(_score(held, ""), shape.replace(f"`{text_col}` ", "`_text` ")).withColumnRenamed("_text", text_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, n_passages, passages (start:end, comma-joined).

    Spans count words. A null id is not held out; repeated rows are scored each; an empty table gives an
    empty result. See fit_toxicity() and score_rows().
    """
    model = fit_toxicity(docs, labels, id_col, text_col, toxic_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t"))
    out = score_rows(rows, model, "_t")
    held = F.coalesce(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    spans = F.transform("_passages", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return out.select(
        F.col("_id").alias(id_col),
        held.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.size("_passages").cast("long").alias("n_passages"),
        F.array_join(spans, ",").alias("passages"),
    )
