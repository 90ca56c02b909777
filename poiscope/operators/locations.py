"""Business queries on a table of points of interest.

Every function takes the locations table and returns a lazy DataFrame. Orders name a full
tie-break, with NULLs last, so that results and top-n cuts are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poiscope.functions.exprs import (
    DINING_CATEGORY,
    RETAIL_CATEGORIES,
    WEEKDAYS,
    blank,
    col,
    distinct_list,
    has_chain,
    hour_of,
    is_open,
    open_retail,
    percent,
    rounded,
    value_list,
)

# Opening hours assumed when none are recorded, and the window they give.
ASSUMED_OPEN = "09:00:00"
ASSUMED_CLOSE = "17:00:00"
ASSUMED_WINDOW_HOURS = 8
LOW_CONFIDENCE = 0.7

CONFIDENCE = "data_quality_confidence_score"


def active_distribution_points(df: DataFrame, min_confidence: float = 0.0, city: str | None = None) -> DataFrame:
    """Open retail locations with an address and enough confidence, best first within a city."""
    kept = open_retail(df).filter(F.col("address").isNotNull() & (F.col(CONFIDENCE) >= F.lit(min_confidence)))
    if city and city != "All Cities":
        kept = kept.filter(F.col("city") == F.lit(city))
    return kept.select(
        "location_id", "name", "chain_name", "main_category", "sub_category", "address", "city", "state",
        "postal_code", "latitude", "longitude", "open_closed_status", CONFIDENCE,
    ).orderBy(F.col("city").asc_nulls_last(), F.col(CONFIDENCE).desc_nulls_last(), F.col("location_id").asc_nulls_last())


def _weekday(day: str) -> str:
    day = day.lower()
    if day not in WEEKDAYS:
        raise ValueError(f"unknown day {day!r}; expected one of {', '.join(WEEKDAYS)}")
    return day


def delivery_windows(df: DataFrame, day: str = "monday") -> DataFrame:
    """Opening hours of a day with defaults, and the whole hours between them (negative overnight)."""
    day = _weekday(day)
    opens, closes = F.col(f"{day}_open"), F.col(f"{day}_close")
    hours = F.when(opens.isNotNull() & closes.isNotNull(), hour_of(closes) - hour_of(opens)).otherwise(F.lit(ASSUMED_WINDOW_HOURS))
    return (
        open_retail(df)
        .select(
            "location_id", "name", "address", "city", "main_category", "sub_category",
            F.coalesce(opens, F.lit(ASSUMED_OPEN)).alias(f"{day}_open"),
            F.coalesce(closes, F.lit(ASSUMED_CLOSE)).alias(f"{day}_close"),
            hours.alias("window_hours"),
        )
        .orderBy(F.col("window_hours").desc_nulls_last(), F.col("location_id").asc_nulls_last())
    )


def delivery_windows_strict(df: DataFrame, day: str = "monday") -> DataFrame:
    """Hours of a day for the locations that record both times."""
    day = _weekday(day)
    opens, closes = F.col(f"{day}_open"), F.col(f"{day}_close")
    return (
        df.filter(opens.isNotNull() & closes.isNotNull())
        .select(
            "location_id", "name",
            hour_of(opens).alias("open_hour"),
            hour_of(closes).alias("close_hour"),
            (hour_of(closes) - hour_of(opens)).alias("window_hours"),
        )
        .orderBy(F.col("window_hours").desc_nulls_last(), F.col("location_id").asc_nulls_last())
    )


def chain_store_targets(df: DataFrame, min_locations: int = 2) -> DataFrame:
    """Chains with enough open retail locations: size, cities, confidence."""
    return (
        open_retail(df)
        .filter(has_chain())
        .groupBy("chain_name")
        .agg(
            F.count(F.lit(1)).alias("location_count"),
            distinct_list("city").alias("cities"),
            F.min(CONFIDENCE).alias("min_confidence"),
            F.max(CONFIDENCE).alias("max_confidence"),
            F.avg(CONFIDENCE).alias("avg_confidence"),
        )
        .filter(F.col("location_count") >= min_locations)
        .orderBy(F.col("location_count").desc(), F.col("chain_name").asc_nulls_last())
    )


def _city_coverage(df: DataFrame, distinct_as: str) -> DataFrame:
    return (
        open_retail(df)
        .filter(F.col("city").isNotNull() & F.col("state").isNotNull())
        .groupBy("city", "state")
        .agg(F.count(F.lit(1)).alias("location_count"), F.count_distinct("sub_category").alias(distinct_as))
    )


def distribution_gaps(df: DataFrame, min_locations: int = 20) -> DataFrame:
    """Cities with fewer open retail locations than asked, thinnest first."""
    return (
        _city_coverage(df, "category_count")
        .filter(F.col("location_count") < min_locations)
        .orderBy("location_count", "city", "state")
    )


def territory_coverage(df: DataFrame) -> DataFrame:
    """Locations and category diversity per city."""
    return (
        _city_coverage(df, "category_diversity")
        .withColumn("diversity_ratio", rounded(F.try_divide(F.col("category_diversity").cast("double"), F.col("location_count").cast("double")), 2))
        .orderBy(F.col("location_count").desc(), "city", "state")
    )


def retail_segments(df: DataFrame) -> DataFrame:
    """Open retail locations per sub-category with the share of the total."""
    counts = (
        open_retail(df)
        .filter(~blank("sub_category"))
        .groupBy(F.col("sub_category").alias("category"))
        .agg(F.count(F.lit(1)).alias("location_count"))
    )
    total = counts.agg(F.sum("location_count").alias("total")).scalar()
    return counts.withColumn("percentage", rounded(percent(F.col("location_count"), total), 2)).orderBy(
        F.col("location_count").desc(), "category"
    )


def competitive_density(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Busiest postal codes with their mix of retail types."""
    return (
        open_retail(df)
        .filter(F.col("postal_code").isNotNull())
        .groupBy("postal_code", "city")
        .agg(
            F.count(F.lit(1)).alias("total_locations"),
            F.count_if(F.col("main_category") == RETAIL_CATEGORIES[0]).alias("retail_locations"),
            F.count_if(F.col("main_category") == RETAIL_CATEGORIES[1]).alias("grocery_locations"),
            F.count_if(has_chain()).alias("chain_locations"),
            distinct_list("sub_category").alias("retail_types"),
        )
        .orderBy(F.col("total_locations").desc(), "postal_code", F.col("city").asc_nulls_last())
        .limit(top_n)
    )


def customer_engagement(df: DataFrame, min_locations: int = 5) -> DataFrame:
    """Popularity, sentiment and dwell time per category with more than `min_locations` open places."""
    return (
        df.filter(F.col("main_category").isin(*RETAIL_CATEGORIES, DINING_CATEGORY) & is_open())
        .groupBy("main_category", "sub_category")
        .agg(
            F.count(F.lit(1)).alias("location_count"),
            rounded(F.avg(F.col("popularity_score").cast("float")), 1).alias("avg_popularity"),
            rounded(F.avg(F.col("sentiment_score").cast("float")), 2).alias("avg_sentiment"),
            rounded(F.avg(F.col("dwell_time").cast("float")), 1).alias("avg_dwell_minutes"),
        )
        .filter(F.col("location_count") > min_locations)
        .orderBy(
            F.col("avg_popularity").desc_nulls_last(), F.col("avg_sentiment").desc_nulls_last(),
            "main_category", F.col("sub_category").asc_nulls_last(),
        )
    )


def geographic_clusters(df: DataFrame, min_cluster_size: int = 3) -> DataFrame:
    """Grid cells of two decimals within a postal code that hold enough open retail locations.

    Rows of a cell are first combined per category and chain, so the lists are built from the
    combined rows only and a hot cell reaches its final task already reduced.
    """
    cells = (
        open_retail(df)
        .filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(
            "postal_code",
            rounded(F.col("latitude"), 2).alias("latitude_area"),
            rounded(F.col("longitude"), 2).alias("longitude_area"),
            "main_category",
            "chain_name",
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        cells.groupBy("postal_code", "latitude_area", "longitude_area")
        .agg(
            F.sum("n").alias("locations_in_cluster"),
            value_list("main_category").alias("business_types"),
            value_list("chain_name").alias("chains_in_area"),
        )
        .filter(F.col("locations_in_cluster") >= min_cluster_size)
        .orderBy(
            F.col("locations_in_cluster").desc(), F.col("postal_code").asc_nulls_last(), "latitude_area", "longitude_area"
        )
    )


def critical_completeness(df: DataFrame) -> DataFrame:
    """One row: how many open retail locations lack address, hours, website or confidence."""
    return open_retail(df).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(blank("address")).alias("missing_address"),
        F.count_if(blank("monday_open") | blank("monday_close")).alias("missing_hours"),
        F.count_if(blank("website")).alias("missing_website"),
        F.count_if(F.col(CONFIDENCE) < LOW_CONFIDENCE).alias("low_confidence"),
    )


def chain_data_quality(df: DataFrame, min_locations: int = 3) -> DataFrame:
    """Missing fields and confidence of chains with more than `min_locations` locations."""
    return (
        open_retail(df)
        .filter(has_chain())
        .groupBy("chain_name")
        .agg(
            F.count(F.lit(1)).alias("total_locations"),
            F.count_if(F.col("address").isNull()).alias("missing_address"),
            F.count_if(F.col("monday_open").isNull() | F.col("monday_close").isNull()).alias("missing_hours"),
            F.count_if(F.col("website").isNull()).alias("missing_website"),
            rounded(F.avg(CONFIDENCE), 2).alias("avg_confidence_score"),
        )
        .filter(F.col("total_locations") > min_locations)
        .orderBy(F.col("total_locations").desc(), F.col("avg_confidence_score").asc_nulls_last(), F.col("chain_name").asc_nulls_last())
    )


def chain_spread(df: DataFrame, min_locations: int = 3) -> DataFrame:
    """Businesses of one name over postal codes and cities.

    Rows are first combined per (name, postal code, city), which also breaks up a hot name; the
    two distinct counts then run on the combined rows.
    """
    combined = df.groupBy("name", "postal_code", "city").agg(
        F.count(F.lit(1)).alias("n"), F.sum(CONFIDENCE).alias("score"), F.count(CONFIDENCE).alias("scored")
    )
    return (
        combined.groupBy(F.col("name").alias("chain_name"))
        .agg(
            F.sum("n").alias("location_count"),
            F.count_distinct("postal_code").alias("postal_codes_covered"),
            F.count_distinct("city").alias("cities_covered"),
            rounded(F.try_divide(F.sum("score"), F.sum("scored").cast("double")), 2).alias("avg_confidence"),
        )
        .filter(F.col("location_count") >= min_locations)
        .orderBy(F.col("location_count").desc(), F.col("chain_name").asc_nulls_last())
    )


def top_rows(result: DataFrame, by: str, n: int, *tie_break: str) -> DataFrame:
    """The n rows of a result with the highest `by`."""
    return result.orderBy(col(by).desc_nulls_last(), *[col(t).asc_nulls_last() for t in tie_break]).limit(n)


# Result name -> operator, as `run_all` returns them.
ANALYSES = {
    "distribution_points": active_distribution_points,
    "delivery_windows": delivery_windows,
    "chain_targets": chain_store_targets,
    "distribution_gaps": distribution_gaps,
    "retail_segments": retail_segments,
    "competitive_density": competitive_density,
    "customer_engagement": customer_engagement,
    "territory_coverage": territory_coverage,
    "geographic_clusters": geographic_clusters,
    "data_completeness": critical_completeness,
    "chain_data_quality": chain_data_quality,
}


def run_all(df: DataFrame, persist: bool = False) -> dict[str, DataFrame]:
    """All analyses by result name, lazily.

    Each analysis reads few columns, so by default each scans the table by itself. With
    `persist` the open locations of the needed categories are kept between them, spilling to
    disk; that pays when the table is expensive to derive. The kept frame is returned as "_base",
    for `unpersist()` afterwards.
    """
    if not persist:
        return {name: analysis(df) for name, analysis in ANALYSES.items()}
    base = df.filter(F.col("main_category").isin(*RETAIL_CATEGORIES, DINING_CATEGORY) & is_open()).persist()
    return {name: analysis(base) for name, analysis in ANALYSES.items()} | {"_base": base}
