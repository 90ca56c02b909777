"""Hand-made frames for the edges of each rule."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poiscope.functions import roles
from poiscope.operators import chartdata, dimension_quality, grading, issues, locations, profile
from poiscope.operators.type_inference import detect_types


def rows(df):
    return [tuple(r) for r in df.collect()]


def keyed(df, *value):
    return {r["column"]: tuple(r[v] for v in value) if len(value) > 1 else r[value[0]] for r in df.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, name string, latitude double, longitude double, opened_date string, category string")
    assert keyed(profile.missing_values(df), "missing_count", "missing_pct")["name"] == (0, None)
    assert rows(profile.duplicate_rows(df)) == [(0, 0, None)]
    assert rows(profile.coordinate_validity(df))[0][1:3] == (0, None)
    assert rows(profile.name_quality(df)) == [(0, 0, None, 0, None)]
    assert keyed(profile.temporal_profile(df), "missing_count", "min_date") == {"opened_date": (0, None)}
    assert rows(profile.validate_table(df)) == [(1, "Table is empty")]
    assert rows(profile.quality_score(df)) == [(100.0, 100.0)]
    assert rows(profile.category_distribution(df)) == []
    assert rows(chartdata.histogram(df, "latitude")) == []
    assert rows(issues.iqr_outliers(df, ["latitude"])) == []
    assert keyed(profile.mixed_types(df), "mixed") == {"name": False, "opened_date": False, "category": False}


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2)], "a string, b double, id int")
    found = keyed(detect_types(df, ["id"]), "inferred_type")
    assert found == {"a": "empty", "b": "empty", "id": "numeric"}
    assert rows(profile.validate_table(df, required=["id"])) == [(3, "Columns with all null values: a, b")]
    assert issues.outlier_bounds(df, ["b"]) == {}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert keyed(profile.missing_values(df), "missing_count", "missing_pct") == {"x": (2, 66.67)}
    assert rows(chartdata.histogram(df, "x"))[0][3] == 1


def test_percentages_round_half_even(spark):
    df = spark.range(800).select(F.when(F.col("id") > 0, 1).alias("x"))  # 0.125 % missing
    assert keyed(profile.missing_values(df), "missing_pct") == {"x": 0.12}


def test_null_and_empty_groups(spark):
    schema = "main_category string, open_closed_status string, chain_id string, chain_name string, city string, data_quality_confidence_score double"
    df = spark.createDataFrame(
        [("retail", "open", "", "A", None, 0.5), ("retail", "open", None, "B", "x", 0.5), ("retail", "open", "1", None, None, 0.5), ("retail", "open", "1", None, "y", 1.0)],
        schema,
    )
    assert rows(locations.chain_store_targets(df)) == [(None, 2, "y", 0.5, 1.0, 0.75)]


def test_window_over_midnight_is_negative(spark):
    schema = "location_id int, name string, address string, city string, main_category string, sub_category string, open_closed_status string, friday_open string, friday_close string"
    df = spark.createDataFrame(
        [(1, "a", None, None, "retail", None, "open", "18:00:00", "02:00:00"), (2, "b", None, None, "retail", None, "open", None, "20:00:00")], schema
    )
    assert [(r.location_id, r.friday_open, r.window_hours) for r in locations.delivery_windows(df, "Friday").collect()] == [(2, "09:00:00", 8), (1, "18:00:00", -16)]
    with pytest.raises(ValueError):
        locations.delivery_windows(df, "someday")


def test_date_format_cascade(spark):
    half = [("2024-01-31", "01/31/2024", "31/01/2024", "2024-01-31 10:00:00"), (None, "junk", None, "junk")]
    df = spark.createDataFrame(half, "iso_date string, us_date string, eu_date string, free_time string")
    found = keyed(profile.temporal_profile(df), "min_date", "missing_count", "format_issues")
    assert found == {
        "iso_date": ("2024-01-31", 1, False), "us_date": ("2024-01-31", 0, False),
        "eu_date": ("2024-01-31", 1, False), "free_time": ("2024-01-31", 0, False),
    }
    mostly_junk = spark.createDataFrame([("2024-01-31",), ("x",), ("y",)], "a_date string")
    assert keyed(profile.temporal_profile(mostly_junk), "parsed_count") == {"a_date": 1}  # by the free reading
    clock = spark.createDataFrame([("08:00:00",)], "monday_open string")
    assert keyed(profile.temporal_profile(clock), "min_date", "format_issues") == {"monday_open": (None, True)}


def test_type_precedence(spark):
    data = [
        (i, f"2024-01-{i + 10}", f"+1 208 555 000{i}", f"u{i}@example.com", f"https://a{i}.example.com/x", "abc"[i % 3], f"text {i}", "2024-01-01" if i else "other")
        for i in range(9)
    ]
    df = spark.createDataFrame(data, "id int, iso string, phone string, email string, url string, few string, words string, some_dates string")
    kinds = keyed(detect_types(df, ["id"]), "inferred_type")
    assert kinds == {
        "id": "numeric", "iso": "phone_number", "phone": "phone_number", "email": "email", "url": "url",
        "few": "text", "words": "text", "some_dates": "date_string",
    }
    many = df.select("id", "few").crossJoin(spark.range(10).select(F.col("id").alias("n")))
    found = {r["column"]: r for r in detect_types(many, ["id", "n"]).collect()}["few"]
    assert (found.inferred_type, found.categories, found.category_count) == ("categorical", "a, b, c", 3)


def test_ten_percent_distinct_is_not_categorical(spark):
    df = spark.range(30).select("id", (F.col("id") % 3).cast("string").alias("c"))
    assert keyed(detect_types(df, ["id"]), "inferred_type")["c"] == "text"


def test_digits_rule(spark):
    exactly = spark.createDataFrame([("12",), ("1.5",), ("1.2.3",), ("7",), ("-3",)], "code string")
    assert rows(issues.number_as_text(exactly)) == []
    above = exactly.union(spark.createDataFrame([("8",)], "code string"))
    assert rows(issues.number_as_text(above)) == [("code", 5, 6, 0.833333)]


def test_flat_column_with_spike(spark):
    df = spark.createDataFrame([(5.0,)] * 20 + [(100.0,)], "price double")
    assert rows(issues.iqr_outliers(df)) == [("price", 5.0, 5.0, 1, 100.0, 100.0, 100.0, 100.0)]


def test_coordinates_row_wise(spark):
    df = spark.createDataFrame([(45.0, 10.0), (95.0, 10.0), (45.0, None), (90.0, -180.0)], "lat double, lng double")
    r = profile.coordinate_validity(df).first()
    assert (r.valid_count, r.invalid_count, r.null_count) == (2, 2, 1)


def test_hierarchy(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), (None, "q")], "department string, category string")
    assert rows(issues.category_hierarchy(df)) == [("department", "category", "a", 2)]
    assert rows(issues.category_hierarchy(df.select("category"))) == []


@pytest.mark.parametrize(("missing", "level"), [(20, "warning"), (21, "critical"), (5, "info"), (6, "warning"), (0, None)])
def test_missing_thresholds_are_strict(spark, missing, level):
    df = spark.range(100).select("id", F.when(F.col("id") >= missing, "v").alias("x"))
    found = [r.level for r in grading.graded_issues(df).collect() if r.type.endswith("missing_values")]
    assert found == ([level] if level else [])


@pytest.mark.parametrize(("copies", "level"), [(10, "warning"), (11, "critical"), (1, "info"), (2, "warning"), (0, None)])
def test_duplicate_thresholds_are_strict(spark, copies, level):
    df = spark.range(100).select(F.when(F.col("id") < copies, F.lit(-1)).otherwise(F.col("id")).alias("x"))
    df = df.union(spark.createDataFrame([(-1,)], "x bigint")) if copies else df
    df = df.filter("x <> 99") if copies else df  # still 100 rows
    found = [r.level for r in grading.graded_issues(df).collect() if r.type.endswith("duplicate_rows")]
    assert found == ([level] if level else [])


def test_same_null_pattern_shift_is_not_a_duplicate(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    assert profile.duplicate_rows(df).first().duplicate_count == 1
    nested = df.select(F.array("x", "y").alias("l"), F.create_map(F.lit("k"), F.col("x")).alias("m"))
    assert profile.duplicate_rows(nested).first().duplicate_count == 1
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert profile.duplicate_rows(zeros).first().duplicate_count == 2


def test_grade_limits(spark):
    df = spark.createDataFrame(
        [("m", f"s{i}") for i in range(6) for _ in range(10)] + [("m", "rare")], "main_category string, sub_category string"
    )
    r = dimension_quality.category_grades(df).first()
    assert (r.subcategory_count, r.grade) == (7, "warning")
    assert dimension_quality.category_advice(df).count() == 3


def test_score_bands(spark):
    df = spark.createDataFrame([(-5.0,), (50.0,), (75.0,), (75.1,), (120.0,)], "s double")
    assert [r[0] for r in df.select(grading.score_band(F.col("s"))).collect()] == ["red", "red", "orange", "green", "green"]


def test_roles():
    columns = ["Data_Quality_Confidence", "STREET", "Lng", "lat", "main_category", "Phone_2"]
    assert roles.first(columns, "longitude") == "Lng"
    assert roles.resolve(columns, "outlier_exempt") == ["Data_Quality_Confidence"]  # "confidence" holds "id"
    assert roles.first(columns, "category") is None
    assert roles.first(columns, "phone") == "Phone_2"
    assert roles.resolve(columns, "geo", {"geo": ["x"]}) == ["x"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "`a b.c` int, `it's` string")
    assert keyed(profile.missing_values(df), "missing_count") == {"a b.c": 0, "it's": 2}
    assert profile.duplicate_rows(df).first().duplicate_count == 1
    assert keyed(profile.size_profile(df), "bytes") == {"a b.c": 8, "it's": 0}


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3,)] * 4, "x int")
    assert rows(chartdata.histogram(df, "x", 30)) == [(15, 3.0, 3.0 + 1 / 30, 4)]


def test_correlation_skips_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, float("nan")), (5.0, 10.0)], "a double, b double")
    assert math.isclose(chartdata.correlation_matrix(df).first().correlation, 1.0)


def test_shares_and_counts_add_up(places):
    shares = [r.percentage for r in locations.retail_segments(places).collect()]
    assert abs(sum(shares) - 100) < 0.01 * len(shares)
    for r in profile.missing_values(places).collect():
        assert 0 <= r.missing_count <= r.row_count
    hist = chartdata.histogram(places, "price_amount").agg(F.sum("rows")).first()[0]
    assert hist == places.filter("price_amount IS NOT NULL").count()


def test_negative_zero_is_zero(spark):
    from poiscope.plans.distincts import exact_distincts

    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "x double")
    assert exact_distincts(df, ["x"]).first()["distinct_count"] == 2


def test_infinite_values_are_outside_every_bin(spark):
    from poiscope.operators.chartdata import correlation_matrix, histogram

    df = spark.createDataFrame([(0.0,), (1.0,), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [(r["bin"], r["rows"]) for r in histogram(df, "x", 2).orderBy("bin").collect()] == [(0, 1), (1, 1)]
    assert correlation_matrix(df).count() == 0


def test_maps_in_another_order_are_equal(spark):
    from poiscope.operators.profile import duplicate_rows

    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(map(1, map('x', 1, 'y', 2))) AS n UNION ALL "
                   "SELECT map('b', 2, 'a', 1), array(map(1, map('y', 2, 'x', 1)))")
    assert duplicate_rows(df).first()["duplicate_count"] == 1


def test_keys_of_distinct_rows(spark):
    from poiscope.operators.profile import distinct_row_keys, key_candidates

    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None)], "k int, s string")
    assert key_candidates(df).count() == 0
    assert [tuple(r) for r in distinct_row_keys(df).collect()] == [("k", 3)]


def test_scratch_is_removed(spark):
    import os

    from poiscope.plans import durable

    held = dict(durable._SCRATCH)
    durable._SCRATCH.clear()
    path = durable.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    durable.remove_scratch(spark)
    assert not os.path.exists(local)
    durable._SCRATCH.update(held)


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from poiscope.plans.durable import shared_dir

    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=None),
    )
    with pytest.raises(ValueError):
        shared_dir(session)


def test_correlations_of_wide_tables(spark):
    rng = np.random.default_rng(4)
    common = rng.normal(size=300)
    data = {f"c{i}": common * (i % 5) + rng.normal(size=300) * 10.0 ** (i % 4) + 1e6 * (i % 3) for i in range(40)}
    data["flat"] = np.full(300, 0.1)
    frame = pd.DataFrame(data)
    frame = frame.mask(rng.random(frame.shape) < 0.2)
    frame["none"], frame["once"] = np.nan, [1.0] + [np.nan] * 299
    schema = ", ".join(f"{c} double" for c in frame.columns)
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)], schema).repartition(3)
    got = {(r["a"], r["b"]): r["correlation"] for r in chartdata.correlation_matrix(df).collect()}
    assert list(got) and set(got) == set(itertools.combinations(frame.columns, 2))
    expected = frame.corr(min_periods=2)
    for (a, b), r in got.items():
        if pd.isna(expected.loc[a, b]):
            assert r is None or np.isnan(r), (a, b)
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9), (a, b)
