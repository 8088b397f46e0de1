"""Every registered query over the provided tables, with the SQL that another engine gives the same rows for.

Composite expressions are SQL text that both engines read (numbra.functions.exprs); relational shapes are
DataFrame operators here and plain SQL there. Totals of doubles depend on the order of addition, so they are
rounded after the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from numbra.functions import exprs as E
from numbra.functions import semantics as S
from numbra.operators import fingerprint as FP
from numbra.operators import iterative as I
from numbra.operators import linalg as L
from numbra.operators import relational as R
from numbra.operators import triage as TR
from numbra.session import shared_path
from numbra.sources import datagen, logs, tables
from numbra.sources.tables import load


@dataclass(frozen=True)
class Query:
    """A query, its SQL for another engine (None: rows only), and whether the benchmark runs it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    headline: bool = False


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None, headline: bool = False) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        CATALOGUE[name] = Query(run, sql, headline)
        return run

    return keep


def sums(names: list[str], digits: int) -> list:
    return [F.round(F.sum(n), digits).alias(n) for n in names]


# ---- derived inputs: the same text for both engines ----

POINTS = (
    f"SELECT event_id AS id, event_id % 20 AS region, user_id AS vehicle, value * {E.num(0.36)} - {E.num(90)} AS lat, "
    f"CAST(event_id * 7919 % 360000 AS DOUBLE) / {E.num(1000)} - {E.num(180)} AS lon FROM events"
)
READINGS = (
    f"SELECT l_orderkey * 8 + l_linenumber AS sensor_id, CAST(l_orderkey % 48 AS INT) AS machine_id, CAST(l_orderkey % 86400 AS DOUBLE) AS phase, "
    f"{E.num(5)} + {E.num(0.8)} * l_quantity AS temp, {E.num(20)} * l_tax AS vibration, {E.num(95)} + {E.num(130)} * l_discount AS pressure, "
    f"{E.num(2.5)} + {E.num(0.5)} * l_linenumber AS amps FROM lineitem"
)
BOOK = (
    f"SELECT l_orderkey, l_linenumber, {E.num(20)} + {E.num(7)} * l_quantity AS spot, {E.num(20)} + l_extendedprice / {E.num(300)} AS strike, "
    f"{E.num(0.05)} + {E.num(30)} * l_tax AS tau, {E.num(0.08)} + {E.num(5)} * l_discount AS vol FROM lineitem"
)
SIGNALS = (
    f"SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1000 AS INT) AS bucket, l_quantity / {E.num(5)} AS a, "
    f"l_extendedprice / {E.num(10000)} AS b, l_discount * {E.num(100)} AS c FROM lineitem"
)
MIXED = "SELECT l_linenumber AS i, CAST(l_quantity / CAST(2.5 AS DOUBLE) AS FLOAT) AS f, l_extendedprice / CAST(5000 AS DOUBLE) AS d FROM lineitem"
LOGS = f"SELECT event_id, {logs.line('event_id')} AS line FROM events"


def derived(spark: SparkSession, sf: str, text: str, table: str) -> DataFrame:
    load(spark, sf, table).createOrReplaceTempView(table)
    return spark.sql(text)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, POINTS, "events")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, READINGS, "lineitem")


def vector_columns(spark: SparkSession, sf: str, width: int) -> DataFrame:
    return L.flat(load(spark, sf, "embeddings"), "embedding", width)


def flat_sql(width: int, more: str = "") -> str:
    return f"SELECT {more}{', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS c{i}' for i in range(width))} FROM embeddings"


# ---- calc ----


@query("calc_scale_filter", "SELECT event_id, value * CAST(2 AS DOUBLE) + CAST(1 AS DOUBLE) AS scaled FROM events WHERE value > CAST(0.5 AS DOUBLE)", True)
def calc_scale_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.calc(load(spark, sf, "events"), {"event_id": "event_id", "scaled": "value * 2.0D + 1.0D"}, "value > 0.5D")


EXACT = {
    "absolute": "ABS(l_quantity - CAST(25 AS DOUBLE))", "root": "SQRT(l_extendedprice)", "down": "CAST(FLOOR(l_extendedprice) AS DOUBLE)",
    "up": "CAST(CEIL(l_extendedprice) AS DOUBLE)", "side": "CAST(SIGN(l_quantity - CAST(25 AS DOUBLE)) AS DOUBLE)",
    "low": "LEAST(l_quantity, l_extendedprice, CAST(30 AS DOUBLE))", "high": "GREATEST(l_quantity, l_tax)", "minus": "-l_extendedprice",
    "product": "l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)", "ratio": "l_extendedprice / l_quantity",
    "wide": "CAST(l_linenumber AS DOUBLE) + l_quantity", "flag": "l_quantity >= CAST(10 AS DOUBLE) AND NOT (l_tax = CAST(0 AS DOUBLE)) OR l_linenumber <> 3",
}


@query("calc_exact_math", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in EXACT.items())} FROM lineitem")
def calc_exact_math(spark: SparkSession, sf: str) -> DataFrame:
    return R.calc(load(spark, sf, "lineitem"), {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", **EXACT})


X = f"(value / {E.num(500)})"
TRANSCENDENTAL = {
    "e": f"EXP({X})", "l": f"LN({X})", "l2": f"LOG2({X})", "s": f"SIN({X})", "c": f"COS({X})", "t": f"TAN({X})", "asn": f"ASIN({X})",
    "acs": f"ACOS({X})", "atn": f"ATAN({X})", "th": f"TANH({X})", "p": f"POWER({X}, {E.num(0.5)})", "at2": f"ATAN2({X}, {E.num(0.3)})",
}


@query("calc_transcendental", f"SELECT event_id, {', '.join(f'ROUND({e}, 9) AS {n}' for n, e in TRANSCENDENTAL.items())} FROM events", True)
def calc_transcendental(spark: SparkSession, sf: str) -> DataFrame:
    # logarithms are IEEE's there: -Infinity at zero, NaN below
    ieee = {"l": S.ieee_ln(F.expr(X)), "l2": S.ieee_log2(F.expr(X))}
    raw = R.calc(load(spark, sf, "events"), {"event_id": "event_id", **TRANSCENDENTAL, **ieee})
    return R.calc(raw, {"event_id": "event_id", **{n: S.round_scaled(F.col(n), 9) for n in TRANSCENDENTAL}})


TRUTH = "SELECT a, b, (a > CAST(0.5 AS DOUBLE)) AND (b > CAST(0.5 AS DOUBLE)) AS both, (a > CAST(0.5 AS DOUBLE)) OR (b > CAST(0.5 AS DOUBLE)) AS any, NOT (a > CAST(0.5 AS DOUBLE)) AS no FROM "
CELLS = ", ".join(f"({x}, {y})" for x in ("CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(NULL AS DOUBLE)") for y in ("CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(NULL AS DOUBLE)"))


@query("calc_three_valued", TRUTH.replace(" AS any", ' AS "any"').replace(" AS both", ' AS "both"') + f"(VALUES {CELLS}) AS t(a, b)")
def calc_three_valued(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TRUTH.replace(" AS any", " AS `any`").replace(" AS both", " AS `both`") + f"(VALUES {CELLS}) AS t(a, b)")


NULLS = "SELECT event_id, NULLIF(event_type, 'click') AS kind, NULLIF(event_type, 'click') IS NULL AS gone, NULLIF(event_type, 'click') IS NOT NULL AS there FROM events"


@query("calc_is_null", NULLS)
def calc_is_null(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, NULLS, "events")


@query("calc_int_div_mod", "SELECT o_orderkey, CAST((o_custkey - 500) // 7 AS BIGINT) AS quotient, (o_custkey - 500) % 7 AS remainder FROM orders")
def calc_int_div_mod(spark: SparkSession, sf: str) -> DataFrame:
    return R.calc(load(spark, sf, "orders"), {"o_orderkey": "o_orderkey", "quotient": "(o_custkey - 500) div 7", "remainder": "(o_custkey - 500) % 7"})


STRICT = "CASE WHEN NULLIF(l_linenumber, 3) IS NULL THEN NULL ELSE {f}(NULLIF(l_linenumber, 3), 4) END"


@query("calc_strict_least", f"SELECT l_orderkey, l_linenumber, {STRICT.format(f='LEAST')} AS low, {STRICT.format(f='GREATEST')} AS high FROM lineitem")
def calc_strict_least(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.expr("nullif(l_linenumber, 3)"), F.lit(4)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.least_strict(a, b).alias("low"), S.greatest_strict(a, b).alias("high"))


for _kind, _text in {
    "int": E.heavy("i"), "float": E.heavy("CAST(f AS DOUBLE)"), "double": E.heavy("d"), "mixed": E.heavy("i", "CAST(f AS DOUBLE)", "d", "i"),
    "passthrough_float": f"({E.heavy('d')} + CAST(f AS DOUBLE))",
}.items():

    @query(f"mixed_type_{_kind}", f"SELECT COUNT(*) AS n, ROUND(SUM({_text}), 3) AS total FROM ({MIXED}) t")
    def mixed_type(spark: SparkSession, sf: str, text: str = _text) -> DataFrame:
        return derived(spark, sf, MIXED, "lineitem").select(F.expr(text).alias("x")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total"))


# ---- geodesic distance ----

KM = E.nearest_depot("lat", "lon", 20)


@query("haversine_nearest", f"SELECT COUNT(*) AS n, ROUND(MIN(km), 6) AS low, ROUND(MAX(km), 6) AS high FROM (SELECT {KM} AS km FROM ({POINTS}) p) t", True)
def haversine_nearest(spark: SparkSession, sf: str) -> DataFrame:
    km = points(spark, sf).select(F.expr(KM).alias("km"))
    return km.agg(F.count("*").alias("n"), F.round(F.min("km"), 6).alias("low"), F.round(F.max("km"), 6).alias("high"))


@query("haversine_near_filter", f"SELECT COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS ids, ROUND(SUM(km), 2) AS total, ROUND(MIN(km), 6) AS low, ROUND(MAX(km), 6) AS high FROM (SELECT id, {KM} AS km FROM ({POINTS}) p) t WHERE km < CAST(1500 AS DOUBLE)")
def haversine_near_filter(spark: SparkSession, sf: str) -> DataFrame:
    near = points(spark, sf).select("id", F.expr(KM).alias("km")).filter("km < 1500.0D")
    return near.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.round(F.sum("km"), 2).alias("total"), F.round(F.min("km"), 6).alias("low"), F.round(F.max("km"), 6).alias("high"))


@query("haversine_by_bucket", f"SELECT COUNT(*) AS groups, ROUND(SUM(total), 2) AS total FROM (SELECT id - (id // 1000) * 1000 AS k, SUM({KM}) AS total FROM ({POINTS}) p GROUP BY 1) t")
def haversine_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    grouped = R.grouped_sum(points(spark, sf), "id - (id div 1000) * 1000", KM)
    return grouped.agg(F.count("*").alias("groups"), F.round(F.sum("total"), 2).alias("total"))


@query("haversine_by_region", f"SELECT region, ROUND(SUM({KM}), 2) AS km FROM ({POINTS}) p GROUP BY region ORDER BY region LIMIT 10", True)
def haversine_by_region(spark: SparkSession, sf: str) -> DataFrame:
    grouped = points(spark, sf).groupBy("region").agg(F.round(F.sum(F.expr(KM)), 2).alias("km"))
    return grouped.orderBy("region").limit(10)


@query("haversine_baseline", f"SELECT COUNT(*) AS n, ROUND(SUM(lat + lon), 3) AS total FROM ({POINTS}) p")
def haversine_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).agg(F.count("*").alias("n"), F.round(F.sum(F.expr("lat + lon")), 3).alias("total"))


@query("fleet_centroid", f"SELECT COUNT(*) AS vehicles, ROUND(SUM({KM}), 3) AS total_km FROM (SELECT vehicle, AVG(lat) AS lat, AVG(lon) AS lon FROM ({POINTS}) p GROUP BY vehicle) t")
def fleet_centroid(spark: SparkSession, sf: str) -> DataFrame:
    centres = points(spark, sf).groupBy("vehicle").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return centres.select(F.expr(KM).alias("km")).agg(F.count("*").alias("vehicles"), F.round(F.sum("km"), 3).alias("total_km"))


@query("topn_then_score", f"SELECT COUNT(*) AS vehicles, ROUND(SUM({KM}), 3) AS total_km FROM (SELECT lat, lon FROM ({POINTS}) p ORDER BY lat, id LIMIT 500) t")
def topn_then_score(spark: SparkSession, sf: str) -> DataFrame:
    top = R.sort_rows(points(spark, sf), "lat", "id", limit=500)
    return top.select(F.expr(KM).alias("km")).agg(F.count("*").alias("vehicles"), F.round(F.sum("km"), 3).alias("total_km"))


# ---- anomaly scores ----

SCORE = E.sensor_score(6)
SENSOR = "SELECT COUNT(*) AS n, CAST(SUM(sensor_id) AS BIGINT) AS ids, ROUND(MIN(score), 9) AS low, ROUND(MAX(score), 9) AS high, ROUND(SUM(score), 4) AS total"


@query("sensor_anomaly", f"{SENSOR} FROM (SELECT sensor_id, {SCORE} AS score FROM ({READINGS}) r) t WHERE score > CAST(6 AS DOUBLE)", True)
def sensor_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    scored = readings(spark, sf).select("sensor_id", F.expr(SCORE).alias("score")).filter("score > 6.0D")
    return scored.agg(
        F.count("*").alias("n"), F.sum("sensor_id").alias("ids"), F.round(F.min("score"), 9).alias("low"), F.round(F.max("score"), 9).alias("high"),
        F.round(F.sum("score"), 4).alias("total"),
    )


DIGEST = f"SELECT machine_id, COUNT(*) AS anomalies, MAX(score) AS worst, AVG(score) AS mean_score FROM (SELECT machine_id, {E.triage_score(8)} AS score FROM ({READINGS}) r) t WHERE score > CAST(60 AS DOUBLE) GROUP BY machine_id"


@query("triage_digest", f"SELECT machine_id, anomalies, worst, ROUND(mean_score, 6) AS mean_score FROM ({DIGEST}) d", True)
def triage_digest(spark: SparkSession, sf: str) -> DataFrame:
    return TR.digest(readings(spark, sf), 8, 60.0).withColumn("mean_score", F.round("mean_score", 6))


@query("triage_fingerprint", f"SELECT COUNT(*) AS machines, CAST(SUM(anomalies) AS BIGINT) AS anomalies, CAST(SUM(machine_id) AS BIGINT) AS id_sum, MAX(worst) AS worst FROM ({DIGEST}) d")
def triage_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return TR.fingerprint(TR.digest(readings(spark, sf), 8, 60.0))


LINE = "concat('machine ', lpad(CAST(machine_id AS VARCHAR), 3, '0'), ': ', CAST(anomalies AS VARCHAR), ' anomalous readings, worst score ', CAST(ROUND(worst, 2) AS VARCHAR), ', mean ', CAST(ROUND(mean_score, 2) AS VARCHAR))"


@query("triage_listagg", f"SELECT string_agg(line, '{TR.SEPARATOR}' ORDER BY line) AS digest FROM (SELECT {LINE} AS line FROM ({DIGEST}) d) t")
def triage_listagg(spark: SparkSession, sf: str) -> DataFrame:
    return TR.joined(TR.digest(readings(spark, sf), 8, 60.0))


WORST = "CAST(ROUND(worst, 2) AS VARCHAR)"
NOTE = f"SELECT 'Inspect first: ' || string_agg('machine ' || lpad(CAST(machine_id AS VARCHAR), 3, '0') || ' (worst ' || {WORST} || ');', ' ' ORDER BY ROUND(worst, 2) DESC, line) AS note"


@query("triage_note", f"{NOTE} FROM (SELECT *, {LINE} AS line FROM ({DIGEST}) d ORDER BY ROUND(worst, 2) DESC, line LIMIT 3) t")
def triage_note(spark: SparkSession, sf: str) -> DataFrame:
    return TR.note(readings(spark, sf), 8, 60.0, accounting=False)


SCREEN = E.vector_screen([f"c{i}" for i in range(8)], 8)
SCREENED = "SELECT COUNT(*) AS n, CAST(SUM(vec_id) AS BIGINT) AS ids, MIN(d2) AS low, MAX(d2) AS high, ROUND(SUM(d2), 6) AS total"


@query("vector_screen", f"{SCREENED} FROM (SELECT vec_id, {SCREEN} AS d2 FROM ({flat_sql(8, 'vec_id, ')}) v) t WHERE d2 < CAST(2.5 AS DOUBLE)")
def vector_screen(spark: SparkSession, sf: str) -> DataFrame:
    near = vector_columns(spark, sf, 8).select("vec_id", F.expr(SCREEN).alias("d2")).filter("d2 < 2.5D")
    return near.agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"), F.min("d2").alias("low"), F.max("d2").alias("high"), F.round(F.sum("d2"), 6).alias("total"))


# ---- option pricing ----

PRICES = {f"pv{i}": E.call_price(s) for i, s in enumerate(E.shocks(5))}


@query("black_scholes_scenarios", f"SELECT COUNT(*) AS n, {', '.join(f'ROUND(SUM({p}), 2) AS {n}' for n, p in PRICES.items())} FROM ({BOOK}) b", True)
def black_scholes_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    priced = derived(spark, sf, BOOK, "lineitem").select(*(F.expr(p).alias(n) for n, p in PRICES.items()))
    return priced.agg(F.count("*").alias("n"), *sums(list(PRICES), 2))


@query("black_scholes_prices", f"SELECT l_orderkey, l_linenumber, ROUND({PRICES['pv0']}, 6) AS price FROM ({BOOK}) b")
def black_scholes_prices(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, BOOK, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.expr(PRICES["pv0"]), 6).alias("price"))


# ---- aggregates ----


@query("grouped_sum", "SELECT CAST(l_linenumber AS INT) AS k, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1", True)
def grouped_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.grouped_sum(load(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice").withColumn("total", F.round("total", 2))


@query("grouped_sum_bucket", "SELECT COUNT(*) AS groups, ROUND(SUM(total), 2) AS total FROM (SELECT l_partkey - (l_partkey // 1000) * 1000 AS k, SUM(l_quantity * CAST(2 AS DOUBLE) + CAST(1 AS DOUBLE)) AS total FROM lineitem GROUP BY 1) t", True)
def grouped_sum_bucket(spark: SparkSession, sf: str) -> DataFrame:
    grouped = R.grouped_sum(load(spark, sf, "lineitem"), "l_partkey - (l_partkey div 1000) * 1000", "l_quantity * 2.0D + 1.0D")
    return grouped.agg(F.count("*").alias("groups"), F.round(F.sum("total"), 2).alias("total"))


@query("global_project_sum", "SELECT ROUND(SUM(l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)), 2) AS total FROM lineitem", True)
def global_project_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.project_sum(load(spark, sf, "lineitem"), "l_extendedprice * (1.0D - l_discount)").withColumn("total", F.round("total", 2))


TERMS = " + ".join(E.region_term(c) for c in ("l_quantity", "l_discount", "l_tax"))


@query("region_bucket_sum_sq", f"SELECT ROUND(SUM(total * total), 2) AS sum_sq FROM (SELECT l_orderkey % 1000 AS k, SUM({TERMS}) AS total FROM lineitem GROUP BY 1) t")
def region_bucket_sum_sq(spark: SparkSession, sf: str) -> DataFrame:
    return R.grouped_sum(load(spark, sf, "lineitem"), "l_orderkey % 1000", TERMS).agg(F.round(F.sum(F.expr("total * total")), 2).alias("sum_sq"))


@query("host_aggregates", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines, MIN(l_quantity) AS low, MAX(l_extendedprice) AS high, ROUND(AVG(l_tax), 9) AS tax FROM lineitem GROUP BY l_returnflag")
def host_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.min("l_quantity").alias("low"), F.max("l_extendedprice").alias("high"), F.round(F.avg("l_tax"), 9).alias("tax"),
    )


@query("fingerprint", "SELECT COUNT(*) AS rows, " + ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}_sum, MIN({c}) AS {c}_min, MAX({c}) AS {c}_max" for c in ("o_orderkey", "o_custkey")) + ", MIN(o_totalprice) AS o_totalprice_min, MAX(o_totalprice) AS o_totalprice_max FROM orders")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return FP.fingerprint(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


for _name, _set in (("all", logs.MATCH_ALL), ("selective", logs.SELECTIVE)):
    _where = " AND ".join(f"regexp_matches(line, '{p}')" for p in _set)

    @query(f"multi_regex_count_{_name}", f"SELECT COUNT(*) AS matches FROM ({LOGS.replace('AS STRING', 'AS VARCHAR')}) l WHERE {_where}", True)
    def multi_regex_count(spark: SparkSession, sf: str, patterns: tuple = _set) -> DataFrame:
        return R.multi_regex_count(derived(spark, sf, LOGS, "events"), "line", patterns)


TEXT_PATTERNS = ("[Tt]h[aeo]", "(ing|ion)", r"[a-z]\.")


@query("multi_regex_count_documents", "SELECT COUNT(*) AS matches FROM documents WHERE " + " AND ".join(f"regexp_matches(text, '{p}')" for p in TEXT_PATTERNS))
def multi_regex_count_documents(spark: SparkSession, sf: str) -> DataFrame:
    return R.multi_regex_count(load(spark, sf, "documents"), "text", TEXT_PATTERNS)


# ---- sorts, joins, window ----


@query("sort_full", "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber", True)
def sort_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.sort_rows(rows, "l_partkey", "l_orderkey", "l_linenumber")


@query("signal_score_sorted", f"SELECT bucket, l_orderkey, l_linenumber, ROUND({E.signal_score()}, 6) AS score FROM ({SIGNALS}) s ORDER BY bucket, l_orderkey, l_linenumber")
def signal_score_sorted(spark: SparkSession, sf: str) -> DataFrame:
    scored = derived(spark, sf, SIGNALS, "lineitem").select("bucket", "l_orderkey", "l_linenumber", F.round(F.expr(E.signal_score()), 6).alias("score"))
    return R.sort_rows(scored, "bucket", "l_orderkey", "l_linenumber")


@query("top_n", "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber LIMIT 100", True)
def top_n(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return R.sort_rows(rows, "l_partkey", "l_orderkey", "l_linenumber", limit=100)


@query("equi_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", True)
def equi_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = R.equi_join(load(spark, sf, "orders"), load(spark, sf, "customer"), "o_custkey", "c_custkey")
    return joined.select("o_orderkey", "c_name", "o_totalprice")


@query("join_fanout", "SELECT o_orderkey, l_linenumber, l_quantity, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey", True)
def join_fanout(spark: SparkSession, sf: str) -> DataFrame:
    joined = R.equi_join(load(spark, sf, "orders"), load(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")
    return joined.select("o_orderkey", "l_linenumber", "l_quantity", "o_custkey")


@query("running_total", "SELECT event_id, value, ROUND(SUM(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM events", True)
def running_total(spark: SparkSession, sf: str) -> DataFrame:
    return R.running_total(load(spark, sf, "events").select("event_id", "value"), "value", "event_id").withColumn("running", F.round("running", 2))


# ---- linear algebra ----


def gram_sql(terms: list[str], inner: str) -> str:
    d = len(terms)
    return "SELECT " + ", ".join(f"ROUND(SUM({terms[i]} * {terms[j]}), 6) AS g_{i}_{j}" for i in range(d) for j in range(i, d)) + f" FROM ({inner}) v"


def rounded(frame: DataFrame, digits: int) -> DataFrame:
    return frame.select(*(F.round(c, digits).alias(c) for c in frame.columns))


@query("gram_matrix_single_16", "SELECT " + ", ".join(f"ROUND(SUM(SIN(c{i}) * SIN(c{j})), 1) AS g_{i}_{j}" for i in range(16) for j in range(i, 16)) + f" FROM ({flat_sql(16)}) v")
def gram_matrix_single_16(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.gram_matrix(vector_columns(spark, sf, 16), [f"SIN(c{i})" for i in range(16)], single=True), 1)


@query("gram_matrix_8", gram_sql([f"c{i}" for i in range(8)], flat_sql(8)))
def gram_matrix_8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.gram_matrix(vector_columns(spark, sf, 8), [f"c{i}" for i in range(8)]), 6)


@query("gram_matrix_sin_16", gram_sql([f"SIN(c{i})" for i in range(16)], flat_sql(16)), True)
def gram_matrix_sin_16(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.gram_matrix(vector_columns(spark, sf, 16), [f"SIN(c{i})" for i in range(16)], "blas"), 6)


DOT = "list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[])"
PAIRS = f"SELECT q.vec_id AS qid, p.vec_id AS rid, {DOT} AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id"


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors with an id divisible by a hundred, the corpus is all vectors; none meets itself."""
    rows = load(spark, sf, "embeddings")
    return rows.filter("vec_id % 100 = 0"), rows


@query("nearest_neighbour", f"SELECT qid, ROUND(MAX(score), 9) AS score FROM ({PAIRS}) t GROUP BY qid", True)
def nearest_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    q, p = sides(spark, sf)
    return L.nearest_neighbour(q, p, "vec_id", "vec_id", others=True).withColumn("score", F.round("score", 9))


@query("reference_join_argmax", f"SELECT qid, rid, ROUND(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS r FROM ({PAIRS}) t) u WHERE r = 1")
def reference_join_argmax(spark: SparkSession, sf: str) -> DataFrame:
    q, p = sides(spark, sf)
    return L.reference_join(q, p, "vec_id", "vec_id", others=True).withColumn("score", F.round("score", 9))


@query("nearest_neighbour_banded", f"SELECT qid, ROUND(MAX(score), 9) AS score FROM ({PAIRS} AND q.label = p.label) t GROUP BY qid")
def nearest_neighbour_banded(spark: SparkSession, sf: str) -> DataFrame:
    q, p = sides(spark, sf)
    return L.nearest_neighbour_banded(q, p, "vec_id", "label", others=True).withColumn("score", F.round("score", 9))


# ---- iterative fits ----

WIDTH, CLUSTERS = 64, 32
DIMS = [f"c{i}" for i in range(WIDTH)]
START = I.spread_centroids(CLUSTERS, WIDTH, 0.2)


def listed(values: list[float]) -> str:
    return f"[{', '.join(repr(float(x)) for x in values)}]::DOUBLE[]"


def kmeans_sql(passes: int, last: str) -> str:
    """Chained passes over lists: a distance to each centroid, the nearest by row_number(), means with the old centroid as a default."""
    values = ", ".join(f"({k}, {listed(c)})" for k, c in enumerate(START))
    parts = ["v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)", f"k0(cid, m) AS (VALUES {values})"]
    means = ", ".join(f"AVG(e[{i + 1}])" for i in range(WIDTH))
    for p in range(passes + 1):
        d = "list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{p} AS (SELECT * FROM (SELECT vec_id, e, cid, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) AS r FROM (SELECT vec_id, e, cid, {d} AS d FROM v, k{p}) u) t WHERE r = 1)")
        parts.append(f"k{p + 1} AS (SELECT k{p}.cid, COALESCE(x, m) AS m FROM k{p} LEFT JOIN (SELECT cid, [{means}] AS x FROM a{p} GROUP BY cid) g ON k{p}.cid = g.cid)")
    return f"WITH {', '.join(parts)} {last}"


@query("kmeans_assign", kmeans_sql(0, "SELECT COUNT(*) AS points, ROUND(SUM(d), 6) AS total FROM a0"), True)
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    return I.kmeans_assign(vector_columns(spark, sf, WIDTH), DIMS, START).withColumn("total", F.round("total", 6))


@query("kmeans_iterate", kmeans_sql(0, f"SELECT cid, COUNT(*) AS members, {', '.join(f'ROUND(SUM(e[{i + 1}]), 6) AS s{i}' for i in range(WIDTH))} FROM a0 GROUP BY cid"))
def kmeans_iterate(spark: SparkSession, sf: str) -> DataFrame:
    found = I.kmeans_iterate(vector_columns(spark, sf, WIDTH), DIMS, START)
    return found.select("cid", "members", *(F.round(f"s{i}", 6).alias(f"s{i}") for i in range(WIDTH)))


@query("kmeans_train_3", kmeans_sql(2, f"SELECT cid, {', '.join(f'ROUND(m[{i + 1}], 6) AS m{i}' for i in range(WIDTH))} FROM k3"), True)
def kmeans_train_3(spark: SparkSession, sf: str) -> DataFrame:
    found = I.kmeans_train(vector_columns(spark, sf, WIDTH), DIMS, START, 3)
    rows = [(k, *(float(x) for x in c)) for k, c in enumerate(found)]
    shape = ", ".join(["cid int", *(f"m{i} double" for i in range(WIDTH))])
    return spark.createDataFrame(rows, shape).select("cid", *(F.round(f"m{i}", 6).alias(f"m{i}") for i in range(WIDTH)))


LABELLED = "SELECT embedding::DOUBLE[] AS e, CAST(label % 2 AS DOUBLE) AS y FROM embeddings"
START_W = [0.5 - i / WIDTH for i in range(WIDTH)]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return vector_columns(spark, sf, WIDTH).withColumn("y", (F.col("label") % 2).cast("double"))


def logreg_sql(start: list[float], passes: int, last: str) -> str:
    """Chained passes over lists; r0, r1, ... hold the rows with their residuals under the weights w0, w1, ..."""
    parts = [f"v AS ({LABELLED})", f"w0(w) AS (VALUES ({listed(start)}))"]
    for p in range(passes + 1):
        parts.append(f"r{p} AS (SELECT e, w, 1 / (1 + EXP(-list_inner_product(e, w))) - y AS r FROM v, w{p})")
        step = ", ".join(f"ANY_VALUE(w[{i + 1}]) - CAST(0.1 AS DOUBLE) * SUM(r * e[{i + 1}]) / COUNT(*)" for i in range(WIDTH))
        parts.append(f"w{p + 1} AS (SELECT [{step}] AS w FROM r{p})")
    return f"WITH {', '.join(parts)} {last}"


@query("logreg_gradient", logreg_sql(START_W, 0, f"SELECT COUNT(*) AS n, {', '.join(f'ROUND(SUM(r * e[{i + 1}]), 9) AS g{i}' for i in range(WIDTH))} FROM r0"))
def logreg_gradient(spark: SparkSession, sf: str) -> DataFrame:
    found = I.logistic_gradient(labelled(spark, sf), DIMS, START_W, "y")
    return found.select("n", *(F.round(f"g{i}", 9).alias(f"g{i}") for i in range(WIDTH)))


@query("logreg_train_2", logreg_sql([0.0] * WIDTH, 1, f"SELECT {', '.join(f'ROUND(w[{i + 1}], 9) AS w{i}' for i in range(WIDTH))} FROM w2"))
def logreg_train_2(spark: SparkSession, sf: str) -> DataFrame:
    weights = I.logistic_train(labelled(spark, sf), DIMS, "y", 2)
    return rounded(spark.createDataFrame([tuple(weights)], ", ".join(f"w{i} double" for i in range(WIDTH))), 9)


# ---- sources and sinks ----


CSV_COLUMNS = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "csv")
    rows = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    tables.insert_into(rows, path, "csv", files=2, sep="\u0001", quote="")
    return tables.read_csv(spark, path, CSV_COLUMNS, delimiter="\u0001", quote=False)


@query("parquet_convert", "SELECT event_id, value FROM events")
def parquet_convert(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "parquet")
    load(spark, sf, "events").select("event_id", "value").createOrReplaceTempView("numbra_events")
    tables.insert_into(spark.table("numbra_events"), path, files=3, mode="overwrite")
    return tables.read_parquet(spark, path, "event_id bigint, value double")


@query("datagen_permutation", f"SELECT CAST((range * {datagen.SHUFFLE}) % 10007 AS BIGINT) AS k, range AS seq, CAST(range AS DOUBLE) AS val FROM range(10007)")
def datagen_permutation(spark: SparkSession, sf: str) -> DataFrame:
    rows = datagen.measurements(spark, 10007)
    return rows.select(datagen.permuted(F.col("id"), 10007).alias("k"), F.col("id").alias("seq"), "val")


# ---- shapes beyond the inventory that a Spark engine has for nothing ----


@query("extra_ranked_window", "SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def extra_ranked_window(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.rank().over(w).cast("long").alias("place"))


@query("extra_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def extra_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, sf, "supplier").select("s_nationkey"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-depot distances over all points."""
    return haversine_nearest(spark, sf)
