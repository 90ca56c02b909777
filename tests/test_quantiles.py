"""The exact percentile search, forced into many scans, against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from poiscope.plans.quantiles import exact_quantiles

PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def check(spark, values, **limits):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    found = exact_quantiles(df, ["x"], PROBS, **limits)["x"]
    assert found == pytest.approx([float(np.quantile(values, p)) for p in PROBS], rel=1e-12, abs=1e-12)


def test_many_scans(spark):
    check(spark, np.random.default_rng(1).lognormal(0, 5, 5000), few=5, digits=3)


def test_hot_values(spark):
    values = [1.0] * 700 + [2.0] * 700 + list(np.linspace(1, 2, 300)) + [-1e300, 1e300]
    check(spark, values, few=3, digits=2)


def test_two_values_only(spark):
    check(spark, [0.0] * 500 + [1.0] * 501, few=1, digits=1)


def test_no_values_and_few_values(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.25, 0.5]) == {"x": [None, None], "y": [1.25, 1.5]}


def test_rare_values(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 1000 = 0 THEN CAST(id AS DOUBLE) END AS x")
    assert exact_quantiles(df, ["x"], [0.5], digits=1, few=2) == {"x": [2000.0]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-20, 20), min_size=1, max_size=60))
def test_any_integers(spark, values):
    check(spark, values, few=2, digits=2)


def test_infinities_zeros_and_extreme_ranges(spark):
    inf = float("inf")
    rows = [-inf] * 3 + [-1e308, -5e-324, -0.0, 0.0, 0.0, 5e-324, 1.0, 1.7e308, inf, inf]
    df = spark.createDataFrame([(v,) for v in rows], "x double")
    at = [i / 12 for i in range(13)]
    for limits in ({}, {"few": 1, "digits": 2}):
        found = exact_quantiles(df, ["x"], at, **limits)["x"]
        assert found == sorted(rows)
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [0.0]


def test_many_columns_and_few_scans(spark):
    rng = np.random.default_rng(2)
    columns = [rng.normal(0, 10.0**i, 400).round(i % 3) for i in range(60)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns)], ", ".join(f"c{i} double" for i in range(60)))
    found = exact_quantiles(df, df.columns, (0.25, 0.75))
    for name, values in zip(df.columns, columns):
        assert found[name] == pytest.approx([float(np.quantile(values, p)) for p in (0.25, 0.75)], rel=1e-12)
