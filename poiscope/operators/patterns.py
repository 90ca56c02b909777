"""Short reports: completeness, duplicates, coverage, formats and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poiscope.functions.exprs import WEEKDAYS, col, is_open, is_retail, missing_sql, open_retail, percent, rounded
from poiscope.operators.locations import CONFIDENCE
from poiscope.plans.longform import per_column, spread

# Confidence levels and postal code formats.
HIGH_CONFIDENCE = 0.9
MEDIUM_CONFIDENCE = 0.7
FIVE_DIGITS = r"^[0-9]{5}$"
NINE_DIGITS = r"^[0-9]{5}-[0-9]{4}$"

# Replacement character, or UTF-8 bytes once read as Latin-1. Our default; pass another if needed.
GARBLED = "�|Ã.|â€"


def completeness_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Total, missing count and missing percentage of each column."""
    return per_column(
        df, columns or df.columns, {"missing_count": lambda c: f"count_if({missing_sql(df, c)})"}, name_as="column_name"
    ).select(
        "column_name",
        F.col("row_count").alias("total_records"),
        "missing_count",
        rounded(percent(F.col("missing_count"), F.col("row_count")), 2).alias("missing_percentage"),
    )


def business_duplicates(df: DataFrame, keys: Sequence[str] = ("name", "address")) -> DataFrame:
    """Groups of rows that agree on the keys."""
    return (
        df.groupBy(*[col(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
        .filter(F.col("occurrence_count") > 1)
    )


def category_parents(df: DataFrame, category: str = "sub_category", parent: str = "main_category") -> DataFrame:
    """Rows and distinct parents of each category."""
    return (
        df.groupBy(col(category).alias("category"))
        .agg(F.count(F.lit(1)).alias("location_count"), F.count_distinct(col(parent)).alias("parent_categories"))
        .orderBy(F.col("location_count").desc(), F.col("category").asc_nulls_last())
    )


def market_coverage(df: DataFrame, area: str = "postal_code", category: str = "main_category") -> DataFrame:
    """Rows and distinct categories of each area."""
    return df.groupBy(col(area)).agg(
        F.count(F.lit(1)).alias("location_count"), F.count_distinct(col(category)).alias("category_diversity")
    )


def confidence_levels(df: DataFrame, score: str = CONFIDENCE) -> DataFrame:
    """Rows per confidence level; a missing score counts as Low."""
    level = (
        F.when(col(score) >= HIGH_CONFIDENCE, "High").when(col(score) >= MEDIUM_CONFIDENCE, "Medium").otherwise("Low")
    )
    return df.groupBy(level.alias("confidence_level")).agg(F.count(F.lit(1)).alias("record_count"))


def hours_coverage(df: DataFrame) -> DataFrame:
    """Locations with opening hours on each day, in one scan."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(f"{d}_open").alias(d) for d in WEEKDAYS])
    rows = [(F.lit(d), F.col("total"), F.col(d)) for d in WEEKDAYS]
    return spread(one, ("day_of_week", "total_locations", "hours_available"), rows).withColumn(
        "completion_rate", rounded(percent(F.col("hours_available"), F.col("total_locations")), 2)
    )


def chains_by_name(df: DataFrame, min_locations: int = 5) -> DataFrame:
    """Business names with enough locations, and their postal codes."""
    return (
        df.groupBy("name")
        .agg(F.count(F.lit(1)).alias("location_count"), F.count_distinct("postal_code").alias("postal_codes_covered"))
        .filter(F.col("location_count") >= min_locations)
    )


def postal_format(postal_code: Column) -> Column:
    return (
        F.when(postal_code.rlike(FIVE_DIGITS), "5-digit").when(postal_code.rlike(NINE_DIGITS), "9-digit").otherwise("other")
    )


def postal_formats(df: DataFrame) -> DataFrame:
    """Rows per postal code format; a missing code counts as other."""
    return df.groupBy(postal_format(F.col("postal_code")).alias("postal_code_format")).agg(
        F.count(F.lit(1)).alias("occurrence_count")
    )


def confidence_summary(df: DataFrame, score: str = CONFIDENCE) -> DataFrame:
    """Mean score and the share of low and high scores."""
    total = F.count(F.lit(1))
    return df.agg(
        rounded(F.avg(col(score)), 6).alias("avg_score"),
        rounded(percent(F.count_if(col(score) < MEDIUM_CONFIDENCE), total), 6).alias("low_pct"),
        rounded(percent(F.count_if(col(score) > HIGH_CONFIDENCE), total), 6).alias("high_pct"),
    )


def hierarchy_cardinality(df: DataFrame, parent: str = "main_category", child: str = "sub_category") -> DataFrame:
    """Distinct parents, children and full pairs, counted on the combined pairs."""
    pairs = df.groupBy(col(parent).alias("p"), col(child).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.count_distinct("p").alias("main_categories"),
        F.count_distinct("c").alias("sub_categories"),
        F.count_if(F.col("p").isNotNull() & F.col("c").isNotNull()).alias("full_hierarchies"),
    )


def open_retail_share(df: DataFrame) -> DataFrame:
    """Open retail locations and their share of all locations."""
    one = df.agg(F.count(F.lit(1)).alias("total_locations"), F.count_if(is_retail() & is_open()).alias("open_retail_locations"))
    return one.withColumn("open_retail_pct", rounded(percent(F.col("open_retail_locations"), F.col("total_locations")), 2))


def city_share(df: DataFrame) -> DataFrame:
    """Open retail locations of each city and their share."""
    counts = open_retail(df).groupBy("city").agg(F.count(F.lit(1)).alias("location_count"))
    total = counts.agg(F.sum("location_count").alias("total")).scalar()
    return counts.withColumn("city_pct", rounded(percent(F.col("location_count"), total), 2)).orderBy(
        F.col("location_count").desc(), F.col("city").asc_nulls_last()
    )


def top_chains(df: DataFrame, n: int = 10) -> DataFrame:
    """Chains with most open retail locations."""
    return (
        open_retail(df)
        .filter(F.col("chain_name").isNotNull())
        .groupBy("chain_name")
        .agg(F.count(F.lit(1)).alias("location_count"))
        .orderBy(F.col("location_count").desc(), "chain_name")
        .limit(n)
    )


def encoding_suspects(df: DataFrame, column: str = "name", pattern: str = GARBLED) -> DataFrame:
    """Rows whose text looks wrongly decoded, and their share."""
    one = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(col(column).rlike(pattern)).alias("suspect_count"))
    return one.withColumn("suspect_pct", rounded(percent(F.col("suspect_count"), F.col("row_count")), 2))


def encoding_suspect_rows(df: DataFrame, column: str = "name", pattern: str = GARBLED) -> DataFrame:
    """The suspect rows themselves."""
    return df.filter(col(column).rlike(pattern))
