"""Secret scanning: fixed shapes, and character Markov models for random strings of any shape.

Two first-order models, of random strings and of ordinary identifiers, are trained from labelled samples; a
token is a secret if the log-likelihood ratio of the two is high. All of it is built-in DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numbra.llm.common import cut
from numbra.llm.spans import apart, find_spans, join_spans, labelled

KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# maximal runs, so the least lengths can stand in the patterns
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Runs of at least this many characters are scored; the ratio grows with the length, so it alone decides.
LEAST_RUN = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}+"
#: Labelled samples: generated strings of each of three alphabets, and about how many documents whose words are ordinary.
RANDOM_SAMPLES, ORDINARY_DOCUMENTS = 2000, 1000
#: Least log-likelihood ratio of a secret (natural logarithm), in all and for each character.
LEAST_RATIO, LEAST_RATE = 12.0, 0.35
_SIDE = 128


def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """Column `sample`: n strings each of hexadecimal, base-64 and base-36 characters, the same in every run."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n=]", "")
    kinds = F.array(F.substring(digest, 1, 40), F.substring(base64, 1, 40), F.upper(F.regexp_replace(F.substring(base64, 41, 40), "[+/]", "7")))
    return spark.range(n).select(F.explode(kinds).alias("sample"))


def ordinary_samples(docs: DataFrame, text_col: str, n: int = ORDINARY_DOCUMENTS) -> DataFrame:
    """Column `sample`: words of about n documents, plain and as snake and camel case with a number.

    Documents are chosen by a share of their texts' hashes, so nothing has to meet in one task; equal texts
    are chosen together and count once.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t")).filter("t is not null")
    share = int((1 << 40) * min(1.0, n / max(1, texts.count())))
    chosen = texts.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < share).distinct()
    words = F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{3,}+(?![A-Za-z0-9])"), F.lit(0))
    pairs = F.zip_with(
        words,
        F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda w, after: F.array(
            F.concat_ws("_", F.lower(w), F.lower(after), F.pmod(F.crc32(w), F.lit(2100)).cast("string")),
            F.concat(w, F.initcap(F.coalesce(after, F.lit(""))), F.pmod(F.crc32(w), F.lit(30)).cast("string")),
            w,
        ),
    )
    return chosen.select(F.explode(F.flatten(pairs)).alias("sample"))


def transition_counts(samples: DataFrame) -> dict[int, int]:
    """Counts of character pairs, as first * 128 + second; characters beyond ASCII count as 127."""
    codes = F.transform(F.split("sample", ""), lambda c: F.least(F.ascii(c), F.lit(_SIDE - 1)))
    pairs = samples.select(F.explode(F.zip_with(codes, F.slice(codes, 2, F.length("sample")), lambda a, b: a * _SIDE + b)).alias("pair")).dropna()
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}  # 128 * 128 rows at most


def ratio_table(random: dict[int, int], ordinary: dict[int, int], smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all transitions, with a count of `smooth` added to each."""

    def logs(counts: dict[int, int]) -> list[float]:
        out = []
        for a in range(_SIDE):
            row = [counts.get(a * _SIDE + b, 0) + smooth for b in range(_SIDE)]
            total = math.log(sum(row))
            out += [math.log(x) - total for x in row]
        return out

    return [a - b for a, b in zip(logs(random), logs(ordinary), strict=True)]


def likelihood_ratio(token: Column, table: Column) -> Column:
    """Sum of the table's entries over the transitions of a token."""
    codes = F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(_SIDE - 1)))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(
        c.alias("last"),
        (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, acc["last"] * _SIDE + c + 1))).alias("sum"),
    )
    return F.aggregate(codes, start, step)["sum"]


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed shapes by kind."""
    has_word = text.rlike(r"(?i:passw|secret|token|api_?key)")
    assign = find_spans(text, ASSIGN, has_word)
    return {
        "assign": F.filter(assign, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6),
        "access": find_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": find_spans(text, HEX, text.rlike("[0-9a-f]{24}")),
    }


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[float] | None = None) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans come from the fixed shapes. A further span (kind `markov`) is a run of LEAST_RUN or more characters
    of A-Za-z0-9+/_=- with a digit and a letter that touches no base span and that the models call random.
    Null texts are empty; null ids are kept and repeated rows are scanned each; an empty table gives an
    empty result; other columns are not read. `table` is a trained ratio table; without one it is trained on samples of `docs`.
    """
    spark = docs.sparkSession
    if table is None:
        table = ratio_table(transition_counts(random_samples(spark)), transition_counts(ordinary_samples(docs, text_col)))
    # one literal, folded once
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    base = base_spans(F.col("_text"))
    tokens = find_spans(F.col("_text"), TOKEN, F.col("_text").rlike(f"[A-Za-z0-9+/_=-]{{{LEAST_RUN}}}"))
    tokens = F.filter(tokens, lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))
    # the scan is done once, before anything reads its columns more than once
    found = cut(rows.select("_id", *(c.alias(f"_{k}") for k, c in base.items()), tokens.alias("_tokens")))
    all_base = F.concat(*(labelled(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)))
    free = apart(F.col("_tokens"), *(F.col(f"_{k}") for k in KINDS))
    rated = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), likelihood_ratio(s["match"], weights).alias("ratio")))
    none = F.array().cast("array<struct<start:int,end:int,ratio:double>>")
    found = found.withColumns({"_base": all_base, "_rated": F.when(F.size("_tokens") > 0, rated).otherwise(none)})
    random = F.filter("_rated", lambda s: (s["ratio"] >= LEAST_RATIO) & (s["ratio"] >= LEAST_RATE * (s["end"] - s["start"])))
    return found.select(
        F.col("_id").alias(id_col),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(join_spans(F.col("_base"), by_kind=False), 256).alias("base_sha256"),
        join_spans(F.concat("_base", labelled(random, "markov", len(KINDS))), by_kind=False).alias("spans"),
    )
