"""Value semantics: three-valued logic, NaN and signed zeros, nulls in least(), division, order and exactness."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from numbra.functions import exprs as E
from numbra.functions import semantics as S
from numbra.operators import relational as R

NAN, INF = float("nan"), float("inf")
DOUBLES = [NAN, -0.0, 0.0, 1.0, -1.0, 0.5, INF, -INF, 2.0, -2.0]


def pairs(spark, values=DOUBLES):
    return spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")


def same(x, y):
    if x is None or y is None:
        return x is y
    return (math.isnan(x) and math.isnan(y)) or (x == y and math.copysign(1, x) == math.copysign(1, y))


@pytest.mark.parametrize("name", ["gt", "ge", "lt", "le", "eq", "ne"])
def test_ieee_comparisons(spark, name):
    a, b = F.col("a"), F.col("b")
    for r in pairs(spark).select("a", "b", getattr(S, f"ieee_{name}")(a, b).alias("x")).collect():
        assert r.x == getattr(r.a, f"__{name}__")(r.b)


def test_total_order(spark):
    order = [-INF, -2.0, -1.0, -0.0, 0.0, 0.5, 1.0, 2.0, INF, NAN]
    place = lambda x: next(i for i, y in enumerate(order) if same(x, y))
    a, b = F.col("a"), F.col("b")
    for r in pairs(spark).select("a", "b", S.total_lt(a, b).alias("lt"), S.total_gt(a, b).alias("gt"), S.total_eq(a, b).alias("eq")).collect():
        assert (r.lt, r.gt, r.eq) == (place(r.a) < place(r.b), place(r.a) > place(r.b), place(r.a) == place(r.b))


def test_division_and_logarithms(spark):
    import numpy as np

    rows = pairs(spark).select("a", "b", S.ieee_div(F.col("a"), F.col("b")).alias("x"), S.ieee_ln(F.col("a")).alias("l"), S.ieee_log2(F.col("a")).alias("l2")).collect()
    with np.errstate(all="ignore"):
        for r in rows:
            assert same(r.x, float(np.float64(r.a) / np.float64(r.b))), r
            assert math.isnan(r.l) if math.isnan(r.a) or r.a < 0 else r.l == float(np.log(r.a))
            assert math.isnan(r.l2) if math.isnan(r.a) or r.a < 0 else math.isclose(r.l2, float(np.log2(r.a)), rel_tol=1e-15) or r.l2 == float(np.log2(r.a))


def test_strict_least_and_greatest(spark):
    frame = spark.createDataFrame([(1.0, None), (None, None), (1.0, NAN), (2.0, 1.0)], "a double, b double")
    got = frame.select(S.least_strict(F.col("a"), F.col("b")).alias("l"), S.greatest_strict(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r.l for r in got] == [None, None, 1.0, 1.0]
    assert [r.g for r in got[:2]] == [None, None] and math.isnan(got[2].g) and got[3].g == 2.0


def test_int_division_truncates(spark):
    frame = spark.createDataFrame([(a, b) for a in (-7, 7, 0, -1) for b in (2, -2, 3)], "a int, b int")
    for r in frame.select("a", "b", S.int_div(F.col("a"), F.col("b")).alias("q")).collect():
        assert r.q == int(r.a / r.b)


def test_three_valued_filter(spark):
    cells = [1.0, 0.0, None]
    frame = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(itertools.product(cells, cells))], "a double, b double, m int")
    assert [r.m for r in frame.filter("a > 0.5D AND b > 0.5D").collect()] == [0]
    assert sorted(r.m for r in frame.filter("a > 0.5D OR b > 0.5D").collect()) == [0, 1, 2, 3, 6]
    assert sorted(r.m for r in frame.filter("NOT (a > 0.5D)").collect()) == [3, 4, 5]


@pytest.mark.parametrize("make", [lambda i: float(i), lambda i: NAN if i % 7 == 0 else 1.0, lambda i: 3.0, lambda i: INF if i % 2 else -INF, lambda i: None])
def test_filter_keeps_what_it_should(spark, make):
    values = [make(i) for i in range(100)]
    frame = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = R.calc(frame, {"id": "id", "w": "v * 2.0D"}, S.ieee_gt(F.col("v"), F.lit(2.0))).collect()
    assert [r.id for r in got] == [i for i, v in enumerate(values) if v is not None and v > 2.0]


def test_squares_are_products(spark):
    frame = spark.createDataFrame([(x,) for x in [*DOUBLES, 1e-200, 1e200, 3.3]], "x double")
    got = frame.select(F.expr(E.square("x")).alias("s"), F.pow("x", F.lit(2.0)).alias("p")).collect()
    assert all(same(r.s, r.p) for r in got)


def test_float_chains_stay_float(spark):
    frame = spark.createDataFrame([(1.1, 2.2)], "f float, g float")
    assert frame.select((F.col("f") * F.col("g")).alias("x")).dtypes == [("x", "float")]
    assert frame.agg(S.float_sum(F.col("f")).alias("x")).dtypes == [("x", "float")]


def test_narrowing_raises(spark):
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        spark.range(1).select((F.col("id") + (1 << 40)).cast("int")).collect()


def test_normal_cdf(spark):
    frame = spark.createDataFrame([(x / 10,) for x in range(-80, 81)], "x double")
    for r in frame.select("x", F.expr(E.normal_cdf("x")).alias("n")).collect():
        assert abs(r.n - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 7.5e-8
    assert E.shocks(1) == [1.0] and E.shocks(2) == [1.0, 0.5] and E.shocks(5)[-1] == 2.0 and E.shocks(5)[1] == 0.5


def test_round_scaled(spark):
    values = {0.5: 1.0, -0.5: -1.0, 1.5: 2.0, 2.5: 3.0, -2.5: -3.0, 0.49999999999999994: 0.0, -0.3: -0.0, 4503599627370495.5: 4503599627370496.0, 9007199254740991.0: 9007199254740991.0, INF: INF, -INF: -INF}
    frame = spark.createDataFrame([(x, y) for x, y in values.items()] + [(NAN, NAN), (None, None)], "x double, y double")
    assert all(same(r.r, r.y) for r in frame.select("y", S.round_scaled(F.col("x"), 0).alias("r")).collect())
    # scaling by 10^9 overflows, or gives 1000000001.4999999
    ends = spark.createDataFrame([(1e308,), (-1e308,), (1.0000000015,)], "x double").select(S.round_scaled(F.col("x"), 9).alias("r")).collect()
    assert [r.r for r in ends] == [1e308, -1e308, 1.000000001]
