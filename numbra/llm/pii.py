"""Personal data by bootstrapped contextual extraction.

Identifiers of fixed shapes are the seeds. The words next to them become lexical patterns; patterns and the
identifier-like tokens that they extract form a graph, in which known tokens score patterns and good patterns
score tokens, round by round, until no token is added. Tokens that confident patterns extract are identifiers
that no shape covers.
All of it is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numbra.llm.common import cut
from numbra.llm.spans import SPACE, apart, find_spans, join_spans, labelled

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# a run that no @ follows holds no start of a match, so runs are taken whole; a match may start where the last one ended
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NUMBER = rf"[0-9][0-9()./-]*+(?![^{SPACE}])"
#: Words of digits with single spaces between them, or any other word with a digit or an at sign.
TOKEN = rf"(?<![^{SPACE}])(?:[+(]?{_NUMBER}(?:\x20[(]?{_NUMBER})*+|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)"
#: Outer punctuation; a label such as `tel:` at the start of a token.
_OUTER = r"^[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++\z"
_TAIL, _HEAD = r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++\z", r"^(?:[^0-9@:=]*+[:=])?[^\p{L}\p{N}+]*+"
_LABEL = r"^([^0-9@:=]*\p{L}[^0-9@:=]*)[:=]"
#: Characters of a token at least; longer ones than this are known by a digest of theirs.
LEAST_CORE, LONG_CORE = 5, 64
#: Least distinct known tokens of a pattern, least share of known ones among all that it extracts, least score
#: (share times log2 of known ones); least confidence of a token.
LEAST_KNOWN, LEAST_SHARE, LEAST_SCORE, LEAST_TRUST = 4, 0.7, 2.0, 0.7


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(match, "[^0-9]", ""), ""))
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed shapes by kind, with the words next to them."""
    ip = find_spans(text, IP, text.rlike(r"[0-9]\.[0-9]"), context=True)
    card = find_spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), context=True)
    phone = find_spans(text, PHONE, F.contains(text, F.lit("+")), context=True)
    digits = lambda s: F.length(F.regexp_replace(s["match"], "[^0-9]", ""))
    return {
        "email": find_spans(text, EMAIL, F.contains(text, F.lit("@")), context=True),
        "ip": F.filter(ip, lambda s: s["match"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(card, lambda s: _luhn(s["match"])),
        "phone": F.filter(phone, lambda s: digits(s).between(8, 15)),
    }


def _core(token: Column) -> Column:
    return F.when(F.length(token) > LONG_CORE, F.sha2(token, 256)).otherwise(token)


def _word(side: Column) -> Column:
    """A neighbouring word in lower case without outer punctuation; long ones by their digests."""
    return F.lower(_core(F.regexp_replace(side, _OUTER, "")))


def candidates(text: Column) -> Column:
    """array<struct<start, end, core, left, right>>: tokens with a digit or @, without outer punctuation, and their neighbours."""

    def one(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["match"], _HEAD, 0))
        core = F.regexp_replace(F.regexp_replace(s["match"], _HEAD, ""), _TAIL, "")
        label = F.regexp_extract(s["match"], _LABEL, 1)
        return F.struct(
            (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(core)).alias("end"), core.alias("core"),
            _word(F.when(label != "", label).otherwise(s["left"])).alias("left"), _word(s["right"]).alias("right"),
        )

    found = F.transform(find_spans(text, TOKEN, text.rlike("[0-9@]"), context=True), one)
    return F.filter(found, lambda c: (F.length(c["core"]) >= LEAST_CORE) & c["core"].rlike("[0-9@]"))


def bootstrap(places: DataFrame, rounds: int | None = None) -> DataFrame:
    """(core, kind, trust) of the tokens that confident patterns add, in at most `rounds` rounds (None: until none is added).

    `places` has a row for each place of a token: core, kind (null: unknown), left and right. A pattern is a
    kind with a left or a right neighbour. Distinct tokens are counted before anything is joined, so copies of
    a text and common neighbours weigh once for each token, and joins meet patterns, never pairs of places.
    """
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("word")), F.struct(F.lit("r").alias("side"), F.col("right").alias("word")))
    edges = places.select("core", "kind", F.explode(sides).alias("p")).select("core", "kind", "p.side", "p.word").filter("word <> ''").distinct()
    edges = cut(edges)
    known = edges.filter("kind is not null").select("core", "kind").distinct().withColumn("trust", F.lit(1.0))
    added = known.filter("false")
    totals = edges.select("side", "word", "core").distinct().groupBy("side", "word").agg(F.count("*").alias("total"))
    graph = edges.select("core", "side", "word").distinct()
    unknown = graph.join(known.select("core").distinct(), "core", "left_anti")
    while rounds is None or rounds > 0:
        hits = graph.join(known.unionByName(added), "core").groupBy("side", "word", "kind").agg(F.count("*").alias("hits"), F.sum("trust").alias("weight"))
        patterns = hits.join(totals, ["side", "word"]).withColumn("share", F.col("weight") / F.col("total"))
        patterns = patterns.filter((F.col("hits") >= LEAST_KNOWN) & (F.col("share") >= LEAST_SHARE) & (F.col("share") * F.log2("hits") >= LEAST_SCORE))
        left = unknown.join(added.select("core"), "core", "left_anti")
        votes = left.join(patterns, ["side", "word"]).groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(1.001 - F.least("share", F.lit(1.0)))))).alias("trust"))
        best = votes.filter(F.col("trust") >= LEAST_TRUST).groupBy("core").agg(F.max_by(F.struct("kind", "trust"), F.struct("trust", "kind")).alias("x"))
        before, added = added, cut(added.unionByName(best.select("core", "x.kind", "x.trust")))
        if added.count() == before.count():
            break
        rounds = rounds and rounds - 1
    return added


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans come from the fixed shapes; further spans (kinds `like_email` and so on) are tokens that
    bootstrapping added, wherever they stand and touch no base span. Null texts are empty; null ids are kept;
    repeated rows get the same spans; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    base = base_spans(F.col("_text"))
    found = rows.select("_id", F.xxhash64("_text").alias("_hash"), *(c.alias(f"_{k}") for k, c in base.items()), candidates(F.col("_text")).alias("_tokens"))
    found = cut(found)
    shape = "array<struct<start:int,end:int,core:string,kind:string,left:string,right:string>>"

    def seeds(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"], s["end"], _core(s["match"]), F.lit(kind), _word(s["left"]), _word(s["right"]))).cast(shape)

    free = apart(F.col("_tokens"), *(F.col(f"_{k}") for k in KINDS))
    others = F.transform(free, lambda s: F.struct(s["start"], s["end"], _core(s["core"]), F.lit(None).cast("string"), s["left"], s["right"])).cast(shape)
    places = found.select("_id", "_hash", F.explode(F.concat(*map(seeds, KINDS), others)).alias("t")).select("_id", "_hash", "t.*")
    added = bootstrap(places.select("core", "kind", "left", "right"), rounds)
    extra = places.filter("kind is null").drop("kind").join(added, "core").select("_id", "_hash", "start", "end", "kind").distinct()
    rank = F.lit(len(KINDS)) + F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    one = F.struct("start", "end", rank.alias("rank"), F.concat(F.lit("like_"), F.col("kind")).alias("kind"))
    # at most the tokens of one document
    extra = extra.groupBy(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2")).agg(F.collect_list(one).alias("_extra"))
    all_base = F.concat(*(labelled(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)))
    slim = found.select("_id", "_hash", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), all_base.alias("_base"))
    out = slim.join(extra, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    everything = F.concat("_base", F.coalesce("_extra", F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")))
    return out.select(
        F.col("_id").alias(id_col),
        *(f"n_{k}" for k in KINDS),
        F.sha2(join_spans(F.col("_base"), by_kind=True), 256).alias("base_sha256"),
        join_spans(everything, by_kind=True).alias("spans"),
    )
