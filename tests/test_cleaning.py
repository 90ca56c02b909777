"""Cleaning steps on small frames, and their invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from poiscope.operators import cleaning, issues, profile
from poiscope.operators.cleaning import ConvertType, FillMissing, HandleOutliers, RemoveDuplicates, StandardizeValues, clean, with_codes
from poiscope.plans.ordering import fill_along, with_index

FILL = "k string, ord int, v string"
GAPS = [("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 4, None), ("b", 5, "y"), ("b", 6, None), ("a", 7, None)]


def values(df, order="ord", column="v"):
    return [r[column] for r in df.orderBy(order).collect()]


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame(GAPS, FILL)


def fill(df, method, *keys):
    return values(clean(df, [FillMissing("v", method=method, order_by=["ord"], partition_by=keys)]).frame)


def test_fill_along_the_table(gaps):
    assert fill(gaps, "forward_fill") == [None, "x", "x", "x", "y", "y", "y"]
    assert fill(gaps, "backward_fill") == ["x", "x", "y", "y", "y", None, None]


def test_fill_within_keys(gaps):
    assert fill(gaps, "forward_fill", "k") == [None, "x", "x", None, "y", "y", "x"]
    assert fill(gaps, "backward_fill", "k") == ["x", "x", None, "y", "y", None, None]


def test_fill_one_hot_key_over_many_slices(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("k"), F.col("id").alias("ord"),
        F.when(F.col("id") % 500 == 1, F.col("id").cast("string")).alias("v"),
    )
    filled = clean(df, [FillMissing("v", method="forward_fill", order_by=["ord"], partition_by=["k"])]).frame
    expected, last = {}, {}
    for r in df.orderBy("ord").collect():
        last[r.k] = r.v if r.v is not None else last.get(r.k)
        expected[r.ord] = last[r.k]
    assert {r.ord: r.v for r in filled.collect()} == expected


def test_fill_needs_an_order(gaps):
    with pytest.raises(ValueError):
        clean(gaps, [FillMissing("v", method="forward_fill")])


def test_fill_values(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 20), (4, 20), (5, 10)], "ord int, v int")
    assert values(clean(df, [FillMissing("v", 0)]).frame) == [10, 0, 20, 20, 10]
    assert values(clean(df, [FillMissing("v", method="mean")]).frame) == [10.0, 15.0, 20.0, 20.0, 10.0]
    assert values(clean(df, [FillMissing("v", method="median")]).frame) == [10.0, 15.0, 20.0, 20.0, 10.0]
    assert values(clean(df, [FillMissing("v", method="mode")]).frame) == [10, 10, 20, 20, 10]  # lowest of a tie
    with pytest.raises(ValueError):
        clean(df, [FillMissing("v", "Unknown")])
    with pytest.raises(ValueError):
        clean(df, [FillMissing("v", method="guess")])


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), (None, 3, "r"), (None, 4, "s")], "k string, ord int, v string")
    assert values(clean(df, [RemoveDuplicates(["k"], "first", ["ord"])]).frame) == ["p", "r"]
    assert values(clean(df, [RemoveDuplicates(["k"], "last", ["ord"])]).frame) == ["q", "s"]
    with pytest.raises(ValueError):
        clean(df, [RemoveDuplicates(["k"])])


def test_duplicates_with_maps(spark):
    df = spark.createDataFrame([(1, {"a": "b"}), (1, {"a": "b"}), (1, {"a": None})], "x int, m map<string,string>")
    assert clean(df, [RemoveDuplicates()]).frame.count() == 2


def test_conversions(spark):
    df = spark.createDataFrame([(1, "2024-05-06", "1.5", "b"), (2, "05/07/2024", "x", "a"), (3, "soon", None, None), (4, None, "2", "b")], "ord int, d string, n string, c string")
    done = clean(df, [ConvertType("d", "date"), ConvertType("n", "numeric"), ConvertType("c", "categorical")])
    assert [str(v)[:10] for v in values(done.frame, column="d")] == ["2024-05-06", "2024-05-07", "None", "None"]
    assert values(done.frame, column="n") == [1.5, None, None, 2.0]
    assert values(done.frame, column="c_code") == [1, 0, None, 1]
    log = {r["column"]: (r.rows_affected, r.newly_null) for r in done.change_log().collect()}
    assert log == {"d": (4, 1), "n": (4, 1), "c": (4, None)}


def test_capping_is_idempotent_and_bounded(places):
    once = clean(places, [HandleOutliers("price_amount")])
    bounds = json.loads(once.change_log().first().params)
    outside = once.frame.filter((F.col("price_amount") < bounds["lower_bound"]) | (F.col("price_amount") > bounds["upper_bound"]))
    assert outside.count() == 0
    assert once.change_log().first().rows_affected == issues.iqr_outliers(places, ["price_amount"]).first().outlier_count
    assert clean(once.frame, [HandleOutliers("price_amount")]).change_log().first().rows_affected == 0


def test_removing_outliers_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,), (1000.0,)], "x double")
    assert clean(df, [HandleOutliers("x", "remove")]).frame.count() == 11
    assert clean(df, [HandleOutliers("x", "other")]).change_log().count() == 0


def test_basic_clean(places):
    done = cleaning.basic_clean(places)
    assert profile.duplicate_rows(done.frame).first().duplicate_count == 0
    assert done.frame.filter("address IS NULL").count() == 0
    again = cleaning.basic_clean(done.frame).change_log().collect()
    assert [r.rows_affected for r in again] == [0, 0]


def test_mapping_by_join_equals_mapping_by_case(spark):
    df = spark.createDataFrame([("1",), ("2",), ("none",), (None,)], "x string")
    large = {str(i): f"v{i}" for i in range(300)}
    small = {k: large[k] for k in ("1", "2")}
    a = clean(df, [StandardizeValues("x", large)])
    b = clean(df, [StandardizeValues("x", small)])
    assert sorted(a.frame.collect(), key=str) == sorted(b.frame.collect(), key=str)
    assert a.change_log().first().rows_affected == b.change_log().first().rows_affected == 2


def test_column_names():
    assert cleaning.standard_names(["A b", "a_b", " C!!d ", "!!"]) == ["a_b", "a_b_2", "c_d", "column"]


def test_before_after(places):
    change = cleaning.before_after(places, cleaning.basic_clean(places).frame)
    row = change.filter("section = 'missing_values' AND column = 'address' AND metric = 'missing_count'").first()
    assert row.before > 0 and row.after == 0
    assert change.filter("metric = 'duplicate_count'").first().after == 0


@pytest.mark.parametrize("slices", [1, 2, 7, 300])
@pytest.mark.parametrize("backward", [False, True])
def test_fill_over_any_slices(spark, slices, backward):
    rng = random.Random(slices)
    rows = [(rng.choice([None, "a", "b"]), i // 3, f"k{i % 3}", rng.random() if rng.random() < 0.1 else None) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "p string, d long, e string, x double").repartition(5)
    for partition_by in ([], ["p"]):
        got = fill_along(df, "x", ["d", "e"], partition_by, backward, slices)
        expected, last = [], {}
        for r in sorted(rows, key=lambda r: (r[1], r[2]), reverse=backward):
            key = r[0] if partition_by else 0
            last[key] = last.get(key) if r[3] is None else r[3]
            expected.append((*r[:3], last[key]))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_order_over_all_types(spark):
    df = spark.sql(
        "SELECT id, CAST(id % 7 AS STRING) AS s, CAST(date '2020-01-01' + CAST(id AS INT) AS TIMESTAMP) AS t, CAST(id / 3 AS DOUBLE) AS d,"
        " unhex(hex(id)) AS b, CAST(id AS DECIMAL(9, 2)) AS n FROM range(200)"
    )
    for order in (["s", "id"], ["t"], ["d"], ["n"], ["b", "id"]):
        got = with_index(df, order, "place", 9).orderBy("place").collect()
        assert [r["place"] for r in got] == list(range(200))
        assert [tuple(r[o] for o in order) for r in got] == sorted(tuple(r[o] for o in order) for r in df.collect())


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_codes_with_hot_and_missing_values(spark, sent_bytes):
    rows = [("hot",)] * 500 + [(None,)] * 300 + [(f"v{i % 90}",) for i in range(200)]
    df = spark.createDataFrame(rows, "x string").withColumn("row", F.monotonically_increasing_id())
    got = with_codes(df, "x", sent_bytes=sent_bytes)
    places = {v: i for i, v in enumerate(sorted({v for (v,) in rows if v is not None}))}
    assert sorted(map(tuple, got.select("x", "x_code").collect()), key=str) == sorted(((v, places.get(v)) for (v,) in rows), key=str)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert ("_turn" in text) == (sent_bytes == 0)


def test_nothing_is_kept_on_disk_for_a_fill(spark, places):
    frame = clean(places, [FillMissing("phone", method="forward_fill", order_by=["location_id"])]).frame
    assert "Scan ExistingRDD" not in frame._jdf.queryExecution().executedPlan().toString()


def test_standardize_between_types(spark):
    df = spark.createDataFrame([(1, "a", True, 2.5), (2, "b", False, 1.0), (None, None, None, None)], "i int, s string, b boolean, d double")

    def mapped(column, mapping):
        done = clean(df, [StandardizeValues(column, mapping)])
        return done.frame.schema[column].dataType.simpleString(), [r[column] for r in done.frame.collect()], done.change_log().first()["rows_affected"]

    assert mapped("i", {1: "one"}) == ("string", ["one", "2", None], 1)
    assert mapped("i", {1: 1.5, 2: 7}) == ("double", [1.5, 7.0, None], 2)
    assert mapped("i", {1.0: 9, "x": 3}) == ("bigint", [9, 2, None], 1)
    assert mapped("i", {1: 5, "01": 6}) == ("bigint", [6, 2, None], 1)
    assert mapped("s", {"a": None}) == ("string", [None, "b", None], 1)
    assert mapped("s", {"a": 7, "b": True}) == ("string", ["7", "true", None], 2)
    assert mapped("b", {True: False}) == ("boolean", [False, False, None], 1)
    assert mapped("b", {True: "yes"}) == ("string", ["yes", "false", None], 1)
    assert mapped("d", {1: 4, 2.5: None}) == ("double", [None, 4.0, None], 2)
