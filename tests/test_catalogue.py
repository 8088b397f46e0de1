"""Every query of the catalogue against its SQL in another engine, over whole small tables."""

import math

import pandas as pd
import pytest

from numbra.plans.catalogue import CATALOGUE
from tests.conftest import SF


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return repr(float(x) + 0.0)
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(cell(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(k for k, q in CATALOGUE.items() if q.sql))
def test_equals_sql(spark, duck, name):
    got, expected = CATALOGUE[name].run(spark, SF).toPandas(), duck(CATALOGUE[name].sql)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_transcendental_outside_domains(spark, duck, tmp_path):
    # logarithms of zero and below, arcs beyond one, halves of the ninth digit; null and NaN are told apart
    odd = [0.0, -0.0, -1.0, 500.0, 500.01, -500.01, 560.21, 1e-320, 5e-324, 2.5e-7, 7.5e-7, -7.5e-7, 785.398163, 1e308, math.nan, math.inf, -math.inf, None]
    spark.createDataFrame(list(enumerate(odd)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    query = CATALOGUE["calc_transcendental"]
    names = [n for n in query.run(spark, str(tmp_path)).columns if n != "event_id"]
    text = ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)  # a frame of doubles would hold NaN for both
    expected = duck(f"SELECT {text} FROM ({query.sql}) t ORDER BY event_id", str(tmp_path)).astype(object)
    got = query.run(spark, str(tmp_path)).orderBy("event_id").collect()
    exact = lambda x: "null" if x is None or x is pd.NA else repr(float(x) + 0.0)
    for n in names:
        assert [exact(r[n]) for r in got] == [exact(None if pd.isna(x) else x) for x in expected[n]], n


def test_note(spark):
    note = CATALOGUE["triage_note"].run(spark, SF).collect()
    assert len(note) == 1 and note[0].note.startswith("Inspect first: machine ")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
