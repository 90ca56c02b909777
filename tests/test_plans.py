"""The physical plans that the scale of the data depends on."""

import contextlib
import io

import pytest

from poiscope.operators import dimension_quality, issues, locations, patterns, profile
from poiscope.operators.cleaning import RemoveDuplicates, basic_clean, before_after, clean
from poiscope.operators.type_inference import detect_types


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(places):
    text = plan(locations.chain_store_targets(places))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    for part in ("In(main_category", "EqualTo(open_closed_status,open)", "IsNotNull(chain_id)"):
        assert part in pushed
    read = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "address" not in read and "phone" not in read


@pytest.mark.parametrize(
    "build",
    [
        dimension_quality.field_group_completeness,
        patterns.hours_coverage,
        profile.missing_values,
        patterns.completeness_by_column,
        profile.coordinate_validity,
        issues.location_issues,
        lambda df: issues.category_hierarchy(df, ["main_category", "sub_category", "chain_name"]),
    ],
)
def test_one_scan(places, build):
    text = plan(build(places))
    assert text.count("Scan parquet") // 2 <= 1 and "CartesianProduct" not in text


def test_wide_counters_do_not_multiply_rows(places):
    assert "Expand" not in plan(profile.missing_values(places))


def test_top_n_is_not_a_full_sort(places):
    assert "TakeOrderedAndProject" in plan(locations.competitive_density(places))


def test_keep_first_cuts_groups_before_the_shuffle(places):
    text = plan(clean(places, [RemoveDuplicates(["name"], "first", ["location_id"])]).frame)
    assert text.count("WindowGroupLimit") >= 2


def test_duplicates_shuffle_identities_only(places):
    text = plan(profile.duplicate_rows(places))
    exchange = text[text.index("Exchange\n", text.index("(1)")) :] if "Exchange\n" in text else text
    assert "row_id_1" in text and "address" not in exchange.split("Arguments")[0]


@pytest.mark.parametrize("name", sorted(locations.ANALYSES))
def test_no_cross_joins(places, name):
    text = plan(locations.ANALYSES[name](places))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def jobs_of(spark, work) -> int:
    """Spark jobs that a piece of work runs; adaptive execution makes each shuffle a job of its own."""
    group = f"counted-{id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def scans_of(df) -> int:
    return plan(df).count("Scan parquet") // 2


def test_all_issues_share_scans(spark, places):
    built = []
    jobs = jobs_of(spark, lambda: built.append(issues.find_issues(places, ["location_id"])))
    assert scans_of(built[0]) <= 4
    assert jobs <= 13
    for name in ("kll", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert name not in plan(built[0])


def test_issues_without_copies_look_for_no_keys(spark, places):
    found = issues.find_issues(places.dropDuplicates(), ["location_id"])
    assert found.filter("family IN ('potential_primary_keys', 'duplicate_rows')").isEmpty()


def test_keys_shuffle_hashes_of_one_width(places):
    text = plan(profile.distinct_row_keys(places))
    outputs = [line for line in text.splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert any("h1" in line and "h2" in line for line in outputs) and not any("address" in line for line in outputs)
    assert scans_of(profile.distinct_row_keys(places)) == 1


def test_profiles_share_scans(places):
    assert scans_of(profile.quality_score(places)) <= 2
    assert scans_of(profile.analyze(places)) <= 6
    assert scans_of(before_after(places, basic_clean(places).frame)) <= 4


def test_types_share_scans(places):
    assert scans_of(detect_types(places, ["location_id"])) <= 4


def test_quartiles_take_few_jobs(spark, places):
    assert jobs_of(spark, lambda: issues.outlier_bounds(places, ["latitude", "dwell_time", "popularity_score"])) <= 9
    assert scans_of(issues.iqr_outliers(places)) == 1
