"""Graded issues, scores and recommendations.

All of it works on the few rows of the profile and issue frames, never on the table itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from poiscope.operators.profile import duplicate_rows, missing_values, mixed_types, quality_score
from poiscope.plans.longform import union_all

# Severities with their weight, and the default limits.
SEVERITY_WEIGHTS = {"critical": 10.0, "warning": 5.0, "info": 1.0}


@dataclass(frozen=True)
class Limits:
    """Percentages above which an issue is critical, a warning or a note."""

    missing: tuple[float, float, float] = (20.0, 5.0, 0.0)
    duplicates: tuple[float, float, float] = (10.0, 1.0, 0.0)


def _level(pct: Column, limits: tuple[float, float, float]) -> Column:
    high, medium, low = limits
    return F.when(pct > high, "critical").when(pct > medium, "warning").when(pct > low, "info")


def _prefix(level: Column) -> Column:
    return F.when(level == "critical", "high").when(level == "warning", "medium").otherwise("low")


def _capital(level: Column) -> Column:
    return F.when(level == "critical", "High").when(level == "warning", "Medium").otherwise("Low")


# Texts of graded issues.
MISSING_SAID = " percentage of missing values in column "
DUPLICATES_SAID = " percentage of duplicate rows: %.2f%%"
MIXED_SAID = ("Mixed data types detected in ", " columns")


def graded_issues(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(level, type, description, affected_columns, details) for missing values, duplicates and mixed types."""
    per = missing_values(df).withColumn("level", _level(F.col("missing_pct"), limits.missing)).filter(F.col("level").isNotNull())
    gaps = per.select(
        "level",
        F.concat(_prefix(F.col("level")), F.lit("_missing_values")).alias("type"),
        F.concat(
            _capital(F.col("level")), F.lit(MISSING_SAID), F.col("column"),
            F.format_string(": %.2f%%", F.col("missing_pct")),
        ).alias("description"),
        F.array("column").alias("affected_columns"),
        F.create_map(F.lit("count"), F.col("missing_count").cast("double"), F.lit("percent"), F.col("missing_pct")).alias("details"),
        "position",
    )
    copies = duplicate_rows(df).withColumn("level", _level(F.col("duplicate_pct"), limits.duplicates)).filter(F.col("level").isNotNull())
    repeats = copies.select(
        "level",
        F.concat(_prefix(F.col("level")), F.lit("_duplicate_rows")).alias("type"),
        F.concat(_capital(F.col("level")), F.format_string(DUPLICATES_SAID, F.col("duplicate_pct"))).alias("description"),
        F.array().cast("array<string>").alias("affected_columns"),
        F.create_map(F.lit("count"), F.col("duplicate_count").cast("double"), F.lit("percent"), F.col("duplicate_pct")).alias("details"),
        F.lit(-1).alias("position"),
    )
    mixed = mixed_types(df).filter("mixed").agg(F.array_sort(F.collect_list(F.struct("position", "column", "classes"))).alias("m"))
    blends = mixed.filter(F.size("m") > 0).select(
        F.lit("warning").alias("level"),
        F.lit("mixed_data_types").alias("type"),
        F.concat(F.lit(MIXED_SAID[0]), F.size("m").cast("string"), F.lit(MIXED_SAID[1])).alias("description"),
        F.transform("m", lambda s: s["column"]).alias("affected_columns"),
        F.map_from_entries(F.transform("m", lambda s: F.struct(s["column"], F.size(F.split(s["classes"], ", ")).cast("double")))).alias("details"),
        F.lit(-1).alias("position"),
    )
    return union_all([gaps, repeats, blends])


def _weight() -> Column:
    pick = F.lit(0.0)
    for level, weight in SEVERITY_WEIGHTS.items():
        pick = F.when(F.col("level") == level, F.lit(weight)).otherwise(pick)
    return pick


def deductions(issues: DataFrame) -> DataFrame:
    """One row per issue with the points it costs."""
    return issues.select(F.col("type").alias("reason"), _weight().alias("deduction"), F.col("description").alias("details"))


def issue_score(issues: DataFrame) -> DataFrame:
    """100 minus the deductions, between 0 and 100."""
    left = F.lit(100.0) - F.coalesce(F.sum(_weight()), F.lit(0.0))
    return issues.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), left)).alias("score"))


def issue_breakdown(issues: DataFrame) -> DataFrame:
    """Issues per severity, zero included."""
    one = issues.agg(*[F.count_if(F.col("level") == level).alias(level) for level in SEVERITY_WEIGHTS])
    rows = F.array(*[F.struct(F.lit(level).alias("severity"), F.col(level).alias("count")) for level in SEVERITY_WEIGHTS])
    return one.select(F.inline(rows))


def column_scores(df: DataFrame) -> DataFrame:
    """100 minus the missing percentage of each column."""
    return missing_values(df).select("column", (F.lit(100.0) - F.col("missing_pct")).alias("score"))


# Recommendation texts on graded issues.
DROP_COLUMNS = "Consider dropping columns with high missing values: "
IMPUTE_COLUMNS = "Impute missing values in columns: "
REMOVE_DUPLICATES = "Remove duplicate rows from the dataset"
STANDARDIZE_TYPES = "Standardize data types in columns: "
PROFILE_MORE = "Run a data profiling tool for more detailed analysis"
DOCUMENT_ISSUES = "Document data quality issues and cleaning steps for reproducibility"


def recommend_operations(issues: DataFrame) -> DataFrame:
    """(position, recommendation) on graded issues."""

    def columns_where(test: Column) -> Column:
        entry = F.when(test, F.struct(F.col("position"), F.array_join("affected_columns", ", ").alias("names")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["names"]), ", ")

    gap = F.col("type").endswith("missing_values")
    # One row per issue at most, so the lists are as long as the table has columns.
    one = issues.agg(
        columns_where(gap & (F.col("level") == "critical")).alias("drop"),
        columns_where(gap & (F.col("level") == "warning")).alias("impute"),
        F.count_if(F.col("type") == "high_duplicate_rows").alias("copies"),
        columns_where(F.col("type") == "mixed_data_types").alias("mixed"),
        F.count(F.lit(1)).alias("total"),
    )
    lines = [
        F.when(F.col("drop") != "", F.concat(F.lit(DROP_COLUMNS), F.col("drop"))),
        F.when(F.col("impute") != "", F.concat(F.lit(IMPUTE_COLUMNS), F.col("impute"))),
        F.when(F.col("copies") > 0, F.lit(REMOVE_DUPLICATES)),
        F.when(F.col("mixed") != "", F.concat(F.lit(STANDARDIZE_TYPES), F.col("mixed"))),
        F.when(F.col("total") > 0, F.lit(PROFILE_MORE)),
        F.when(F.col("total") > 0, F.lit(DOCUMENT_ISSUES)),
    ]
    return one.select(F.posexplode(F.array_compact(F.array(*lines)))).select(
        (F.col("pos") + 1).alias("position"), F.col("col").alias("recommendation")
    )


def quality_report(df: DataFrame, table_name: str, limits: Limits = Limits()) -> DataFrame:
    """One row: score, issues per severity, score per column, recommendations, time of the report."""
    issues = graded_issues(df, limits)
    counts = issue_breakdown(issues).agg(F.map_from_entries(F.collect_list(F.struct("severity", "count"))).alias("issues_summary"))
    columns = column_scores(df).agg(F.map_from_entries(F.collect_list(F.struct("column", "score"))).alias("column_quality"))
    advice = recommend_operations(issues).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "recommendation"))), lambda s: s["recommendation"]).alias("recommendations")
    )
    return issue_score(issues).select(
        F.lit(table_name).alias("table_name"),
        F.col("score").alias("quality_score"),
        counts.scalar().alias("issues_summary"),
        columns.scalar().alias("column_quality"),
        advice.scalar().alias("recommendations"),
        F.current_timestamp().alias("timestamp"),
    )


def key_metrics(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Quality score, number of critical issues and completeness."""
    critical = graded_issues(df, limits).agg(F.count_if(F.col("level") == "critical").alias("n")).scalar()
    return quality_score(df).select("quality_score", critical.alias("critical_issues"), "completeness")


def score_band(score: Column) -> Column:
    """Colour band of a score: up to 50 red, up to 75 orange, else green."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return F.when(clamped <= 50, "red").when(clamped <= 75, "orange").otherwise("green")


# Family of issues -> title and three actions, in report order.
ADVICE = {
    "missing_values": ("Missing Values", (
        "Fill missing values with appropriate defaults",
        "Remove rows with critical missing values",
        "Impute missing values based on other columns",
    )),
    "critical_missing_fields": ("Critical Missing Fields", (
        "Prioritize filling these critical fields",
        "Consider removing rows with missing critical data",
        "Flag records with missing critical data for follow-up",
    )),
    "duplicate_rows": ("Duplicate Rows", (
        "Remove duplicate rows",
        "Identify why duplicates exist in the source system",
        "Implement unique constraints in the database",
    )),
    "potential_primary_keys": ("Missing Primary Key", (
        "Establish a proper primary key",
        "Add a surrogate key if no natural key exists",
        "Ensure referential integrity with related tables",
    )),
    "type_issues": ("Data Type Issues", (
        "Convert string dates to proper date types",
        "Convert numeric strings to proper numeric types",
        "Ensure categorical data is properly encoded",
    )),
    "outliers": ("Outliers", (
        "Cap outliers at a reasonable threshold",
        "Remove extreme outliers",
        "Investigate source of outliers",
    )),
    "outlier_impact": ("Price/Quantity Outliers", (
        "Review extreme price/quantity values",
        "Assess revenue impact of outliers",
        "Implement validation rules for future data entry",
    )),
    "json_columns": ("JSON Data in Strings", (
        "Parse JSON data into proper columns",
        "Extract key JSON attributes to separate columns",
        "Consider using a database with native JSON support",
    )),
    "category_hierarchy_issues": ("Inconsistent Category Hierarchies", (
        "Standardize category hierarchies",
        "Create a reference table for valid category relationships",
        "Fix inconsistent category assignments",
    )),
    "location_data_issues": ("Location Data Issues", (
        "Standardize address formats",
        "Fill in missing geographic coordinates",
        "Validate addresses against a reference database",
    )),
}


def _describe(family: Column) -> Column:
    n = F.col("n").cast("string")
    # The description of each family.
    said = {
        "missing_values": F.concat(F.lit("Found "), n, F.lit(" columns with missing values")),
        "critical_missing_fields": F.concat(F.lit("Found "), n, F.lit(" critical columns with missing values")),
        "duplicate_rows": F.concat(F.lit("Found "), F.col("total").cast("bigint").cast("string"), F.lit(" duplicate rows")),
        "potential_primary_keys": F.concat(F.lit("Consider using one of these columns as a primary key: "), F.col("first_columns")),
        "type_issues": F.concat(F.lit("Found "), n, F.lit(" columns with potential data type issues")),
        "outliers": F.concat(F.lit("Found outliers in "), n, F.lit(" numeric columns")),
        "outlier_impact": F.concat(F.lit("Found outliers in "), n, F.lit(" price or quantity columns with potential business impact")),
        "json_columns": F.concat(F.lit("Found "), n, F.lit(" columns with JSON data stored as strings")),
        "category_hierarchy_issues": F.concat(F.lit("Found "), n, F.lit(" inconsistent category relationships")),
        "location_data_issues": F.lit("Found issues with location/address data"),
    }
    pick = F.lit(None).cast("string")
    for name, text in said.items():
        pick = F.when(family == name, text).otherwise(pick)
    return pick


def cleaning_recommendations(issues: DataFrame) -> DataFrame:
    """(position, issue, description, actions) for each family of issues present.

    `issues` is the result of `find_issues`: a few rows per column of the table.
    """
    families = issues.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.array_join(F.slice(F.array_sort(F.collect_set("column")), 1, 3), ", ").alias("first_columns"),
    )
    names = list(ADVICE)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family"))
    titles = F.array(*[F.lit(ADVICE[n][0]) for n in names])
    actions = F.array(*[F.array(*[F.lit(a) for a in ADVICE[n][1]]) for n in names])
    return (
        families.filter(F.col("family").isin(names))
        .withColumn("position", place.cast("int"))
        .select(
            "position",
            F.element_at(titles, F.col("position")).alias("issue"),
            _describe(F.col("family")).alias("description"),
            F.element_at(actions, F.col("position")).alias("actions"),
        )
    )
