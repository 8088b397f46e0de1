"""Digest of anomalous readings, and a note on it by a pluggable text engine."""

from __future__ import annotations

import atexit
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numbra.functions import exprs as E

# Fixed values of the note's format.
SEPARATOR = " ;; "
NOTHING = "no anomalies"
INTRO = (
    "You are a maintenance engineer. The overnight screen of a machine fleet flagged the readings below. "
    "Each line gives a machine, how many of its readings were anomalous, the worst deviation score and the mean.\n\n"
)
OUTRO = (
    "\nWrite a short triage note: which machines to inspect first and why, in at most six sentences. "
    "Do not invent readings that are not listed."
)
ACCOUNT = (
    "@@TRIAGE engine={engine} model_load_ms={load:.1f} resident={resident} prompt_chars={characters} prompt_tokens={asked} "
    "generated_tokens={made} prefill_ms={prefill:.1f} decode_ms={decode:.1f} inference_wall_ms={wall:.1f} decode_tok_s={rate:.2f}\n"
)


def digest(readings: DataFrame, modes: int, threshold: float | None) -> DataFrame:
    """machine_id, anomalies, worst, mean_score of the readings whose score is above the threshold (all, for None)."""
    scored = readings.select("machine_id", F.expr(E.triage_score(modes)).alias("score"))
    if threshold is not None:
        scored = scored.filter(F.col("score") > float(threshold))
    return scored.groupBy("machine_id").agg(F.count("*").alias("anomalies"), F.max("score").alias("worst"), F.avg("score").alias("mean_score"))


def fingerprint(digested: DataFrame) -> DataFrame:
    """What two runs of a digest must agree on."""
    return digested.agg(F.count("*").alias("machines"), F.sum("anomalies").alias("anomalies"), F.sum("machine_id").alias("id_sum"), F.max("worst").alias("worst"))


def lines(digested: DataFrame) -> DataFrame:
    """One line of text for each machine."""
    text = F.concat(
        F.lit("machine "), F.lpad(F.col("machine_id").cast("string"), 3, "0"), F.lit(": "), F.col("anomalies").cast("string"),
        F.lit(" anomalous readings, worst score "), F.round("worst", 2).cast("string"), F.lit(", mean "), F.round("mean_score", 2).cast("string"),
    )
    return digested.select(text.alias("line"))


def joined(digested: DataFrame) -> DataFrame:
    """All lines in order as one text; machines bound its length."""
    return lines(digested).agg(F.expr(f"listagg(line, '{SEPARATOR}') WITHIN GROUP (ORDER BY line)").alias("digest"))


def prompt(rows: list[str]) -> str:
    return INTRO + "".join(f"- {x}\n" for x in rows) + OUTRO


@dataclass(frozen=True)
class Completion:
    """A text with its token counts and times in nanoseconds."""

    text: str
    prompt_tokens: int
    generated_tokens: int
    prefill_ns: int = 0
    decode_ns: int = 0
    wall_ns: int = 0


class TextEngine(ABC):
    """A text generator: loaded once for each worker, then asked again and again."""

    @abstractmethod
    def load(self) -> None: ...

    @abstractmethod
    def generate(self, text: str, most_tokens: int) -> Completion: ...

    @abstractmethod
    def describe(self) -> str: ...

    def close(self) -> None:
        """Gives back what load() took."""


class RuleEngine(TextEngine):
    """Without a model: names the machines of the worst scores, the same for the same prompt."""

    def load(self) -> None:
        self.ready = True

    def generate(self, text: str, most_tokens: int) -> Completion:
        began = time.perf_counter_ns()
        rows = [x[2:] for x in text.splitlines() if x.startswith("- machine ")]
        worst = sorted(rows, key=lambda x: (-float(x.split("worst score ")[1].split(",")[0]), x))[:3]
        words = ["Inspect first:", *(f"{x.split(':')[0]} (worst {x.split('worst score ')[1].split(',')[0]});" for x in worst)]
        note = " ".join(" ".join(words).split()[:most_tokens])
        spent = time.perf_counter_ns() - began
        return Completion(note, len(text.split()), len(note.split()), 0, spent, spent)

    def describe(self) -> str:
        return "rules"


class PromptServerEngine(TextEngine):
    """A completion server over HTTP: POSTs prompt and n_predict, greedily, and reads content and token counts."""

    def __init__(self, url: str, timeout: float = 300.0):
        self.url, self.timeout = url, timeout

    def load(self) -> None:
        import urllib.request

        with urllib.request.urlopen(f"{self.url}/health", timeout=self.timeout) as answer:
            answer.read()

    def generate(self, text: str, most_tokens: int) -> Completion:
        import json
        import urllib.request

        began = time.perf_counter_ns()
        body = json.dumps({"prompt": text, "n_predict": most_tokens, "temperature": 0}).encode()
        request = urllib.request.Request(f"{self.url}/completion", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.load(answer)
        times = found.get("timings", {})
        return Completion(
            found["content"], int(found.get("tokens_evaluated", 0)), int(found.get("tokens_predicted", 0)),
            int(times.get("prompt_ms", 0) * 1e6), int(times.get("predicted_ms", 0) * 1e6), time.perf_counter_ns() - began,
        )

    def describe(self) -> str:
        return f"server {self.url}"


#: Engines that stay loaded in a Python worker, by description: (engine, load time).
_RESIDENT: dict[str, tuple[TextEngine, int]] = {}


def resident(make: Callable[[], TextEngine]) -> tuple[TextEngine, bool, int]:
    """The worker's engine, whether it was loaded already, and how long loading took."""
    engine = make()
    if (name := engine.describe()) in _RESIDENT:
        return _RESIDENT[name][0], True, _RESIDENT[name][1]
    began = time.perf_counter_ns()
    engine.load()
    atexit.register(engine.close)  # when the worker ends
    _RESIDENT[name] = (engine, time.perf_counter_ns() - began)
    return engine, False, _RESIDENT[name][1]


def report(engine: TextEngine, reused: bool, load_ns: int, characters: int, c: Completion) -> str:
    """The accounting line above a note."""
    rate = c.generated_tokens / (c.decode_ns / 1e9) if c.decode_ns else 0.0
    return ACCOUNT.format(
        engine=engine.describe(), load=load_ns / 1e6, resident=str(reused).lower(), characters=characters, asked=c.prompt_tokens,
        made=c.generated_tokens, prefill=c.prefill_ns / 1e6, decode=c.decode_ns / 1e6, wall=c.wall_ns / 1e6, rate=rate,
    )


def triage_udf(make: Callable[[], TextEngine] = RuleEngine, most_tokens: int = 256, accounting: bool = True):
    """A UDF from a digest to a note. Lines are sorted first, so their order in the digest does not matter;
    null or empty gives a fixed text. The engine stays loaded between batches and queries of a worker."""

    @F.pandas_udf("string")
    def triage(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine, reused, load_ns = resident(make)

        def one(text: str | None) -> str:
            if not text:
                return NOTHING
            asked = prompt(sorted(text.split(SEPARATOR)))
            c = engine.generate(asked, most_tokens)
            return (report(engine, reused, load_ns, len(asked), c) if accounting else "") + c.text

        for batch in batches:
            yield batch.map(one, na_action=None)

    return triage


def note(readings: DataFrame, modes: int, threshold: float, make: Callable[[], TextEngine] = RuleEngine, accounting: bool = True) -> DataFrame:
    """Scores, digest, lines and one note, in one query."""
    return joined(digest(readings, modes, threshold)).select(triage_udf(make, accounting=accounting)("digest").alias("note"))
