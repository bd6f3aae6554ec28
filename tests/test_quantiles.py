import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.operators import quantiles
from flowsieve.operators.quantiles import exact_quantiles


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_equals_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 2000), rng.normal(0, 1e9, 500), np.full(1500, 0.25)])
    df = frame(spark, values)
    probabilities = [0.0, 0.0001, 0.01, 0.3, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, [("x", p) for p in probabilities])
    assert np.allclose(got, np.quantile(values, probabilities), rtol=1e-12)


def test_several_columns_and_nulls(spark):
    df = spark.range(101).select(
        F.col("id").cast("double").alias("a"),
        F.when(F.col("id") % 2 == 0, -F.col("id")).cast("double").alias("b"),
    )
    assert exact_quantiles(df, [("a", 0.25), ("b", 0.5)]) == [25.0, -50.0]


def test_passes_do_not_grow_with_the_spread(spark, monkeypatch):
    """Values over 600 orders of magnitude: a bracket and a count per round, three rounds at most."""
    df = spark.range(40_000).select((10.0 ** (F.col("id") / 66.67 - 300)).alias("x")).cache()
    asked = []
    for name in ("_bracket", "_ranks"):
        monkeypatch.setattr(quantiles, name, lambda *a, f=getattr(quantiles, name): asked.append(1) or f(*a))
    got = exact_quantiles(df, [("x", 0.0001), ("x", 0.5)])
    values = np.array([r.x for r in df.collect()])
    assert np.allclose(got, np.quantile(values, [0.0001, 0.5]), rtol=1e-12) and len(asked) <= 6


def test_one_third_equal_values(spark):
    values = [5.0] * 400 + list(range(800))
    got = exact_quantiles(frame(spark, values), [("x", p / 100) for p in range(0, 101, 10)])
    assert np.allclose(got, np.quantile(values, np.arange(0, 1.01, 0.1)))


def test_extremes_of_the_number_range(spark):
    values = [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324]
    assert exact_quantiles(frame(spark, values), [("x", 0.5), ("x", 0.75)]) == [0.0, 5e-324]


def test_refuses_what_has_no_order(spark):
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="NaN or infinity"):
            exact_quantiles(frame(spark, [1.0, bad]), [("x", 0.5)])
    with pytest.raises(ValueError, match="no values"):
        exact_quantiles(frame(spark, [None]), [("x", 0.5)])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60),
    st.floats(0, 1),
)
def test_any_small_table(spark, monkeypatch, values, p):
    monkeypatch.setattr(quantiles, "ACCURACY", 4)
    got = exact_quantiles(frame(spark, values), [("x", p)])[0]
    assert np.isclose(got, np.quantile(values, p), rtol=1e-9, atol=1e-9)
