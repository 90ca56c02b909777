"""Quality metrics per business dimension, each with a grade critical, warning or good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poiscope.functions.exprs import distinct_list, has_chain, is_open, open_retail, percent, rounded
from poiscope.operators.locations import CONFIDENCE, LOW_CONFIDENCE
from poiscope.plans.longform import spread

# Limits above which a metric is critical / a warning.
ADDRESS_LIMITS = (10, 5)
HOURS_LIMITS = (50, 30)
LOW_CONFIDENCE_LIMITS = (30, 20)
COORDINATE_LIMITS = (10, 5)
RANGE_LIMITS = (0.3, 0.2)
FLOOR_LIMITS = (0.5, 0.7)
FIELD_LIMITS = (50, 25)
SUBCATEGORY_LIMITS = (10, 5)
SMALLEST_SHARE_LIMITS = (1, 5)

# Advice on a main category by its number of sub-categories.
MANY_SUBCATEGORIES_ADVICE = (
    "Consider standardizing subcategories to reduce fragmentation",
    "Merge similar subcategories to improve consistency",
    "Implement data validation rules for category assignments",
    "Review outlier subcategories with very few records",
)
SOME_SUBCATEGORIES_ADVICE = (
    "Review subcategory naming conventions for consistency",
    "Consider consolidating similar subcategories",
    "Implement validation for new category assignments",
)
FEW_SUBCATEGORIES_ADVICE = (
    "Current category hierarchy appears reasonable",
    "Continue monitoring for consistency",
    "Document category definitions to maintain consistency",
)


def _grade(critical: Column, warning: Column) -> Column:
    return F.when(critical, "critical").when(warning, "warning").otherwise("good")


def _over(limits: dict[str, tuple[float, float]], which: int) -> Column:
    test = F.lit(False)
    for name, pair in limits.items():
        test = test | (F.col(name) > pair[which])
    return test


def _graded(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumn("grade", _grade(_over(limits, 0), _over(limits, 1)))


def distribution_quality(df: DataFrame) -> DataFrame:
    """Address, hours and confidence of the open retail categories."""
    total = F.count(F.lit(1))
    metrics = (
        open_retail(df)
        .groupBy("main_category")
        .agg(
            total.alias("total_locations"),
            rounded(F.avg(CONFIDENCE) * F.lit(100.0), 1).alias("avg_confidence_score"),
            percent(F.count_if(F.col("address").isNull()), total).alias("missing_address_pct"),
            percent(F.count_if(F.col("monday_open").isNull()), total).alias("missing_hours_pct"),
            percent(F.count_if(F.col(CONFIDENCE) < LOW_CONFIDENCE), total).alias("low_confidence_pct"),
        )
    )
    limits = {
        "missing_address_pct": ADDRESS_LIMITS,
        "missing_hours_pct": HOURS_LIMITS,
        "low_confidence_pct": LOW_CONFIDENCE_LIMITS,
    }
    return _graded(metrics, limits).orderBy(F.col("total_locations").desc(), "main_category")


def chain_consistency(df: DataFrame, min_locations: int = 3, top_n: int = 10) -> DataFrame:
    """Chains whose confidence varies most between locations."""
    spread_of = F.max(CONFIDENCE) - F.min(CONFIDENCE)
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
            spread_of.alias("confidence_range"),
        )
        .filter(F.col("location_count") >= min_locations)
        .orderBy(
            F.col("confidence_range").desc_nulls_last(), F.col("location_count").desc(), F.col("chain_name").asc_nulls_last()
        )
        .limit(top_n)
        .withColumn(
            "grade",
            _grade(
                (F.col("confidence_range") > RANGE_LIMITS[0]) | (F.col("min_confidence") < FLOOR_LIMITS[0]),
                (F.col("confidence_range") > RANGE_LIMITS[1]) | (F.col("min_confidence") < FLOOR_LIMITS[1]),
            ),
        )
    )


def geographic_quality(df: DataFrame, min_locations: int = 10, top_n: int = 10) -> DataFrame:
    """Cities of lowest confidence; locations without a city form a group of their own."""
    total = F.count(F.lit(1))
    metrics = (
        df.filter(is_open())
        .groupBy("city")
        .agg(
            total.alias("total_locations"),
            rounded(F.avg(CONFIDENCE) * F.lit(100.0), 1).alias("avg_confidence_score"),
            percent(F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()), total).alias("missing_coordinates_pct"),
            percent(F.count_if(F.col("address").isNull()), total).alias("missing_address_pct"),
            percent(F.count_if(F.col(CONFIDENCE) < LOW_CONFIDENCE), total).alias("low_confidence_pct"),
        )
        .filter(F.col("total_locations") >= min_locations)
        .orderBy(F.col("avg_confidence_score").asc_nulls_last(), F.col("city").asc_nulls_last())
        .limit(top_n)
    )
    return _graded(
        metrics,
        {
            "missing_coordinates_pct": COORDINATE_LIMITS,
            "missing_address_pct": ADDRESS_LIMITS,
            "low_confidence_pct": LOW_CONFIDENCE_LIMITS,
        },
    )


def _field_tests() -> list[tuple[str, str, Column]]:
    """(group, field, test for missing), in report order."""
    c = F.col
    return [
        ("Contact Information", "phone", c("phone").isNull()),
        ("Contact Information", "website", c("website").isNull()),
        ("Contact Information", "email", c("email").isNull()),
        ("Location Data", "address", c("address").isNull()),
        ("Location Data", "coordinates", c("latitude").isNull() | c("longitude").isNull()),
        ("Location Data", "postal", c("postal_code").isNull()),
        ("Business Information", "category", c("main_category").isNull()),
        ("Business Information", "hours", c("monday_open").isNull()),
        ("Business Information", "opened_date", c("opened_on").isNull()),
    ]


def field_group_completeness(df: DataFrame) -> DataFrame:
    """Missing share of nine fields in three groups, from one scan of the open locations."""
    tests = _field_tests()
    one = df.filter(is_open()).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(test).alias(field) for _, field, test in tests]
    )
    rows = [(F.lit(group), F.lit(field), F.col("total"), F.col(field)) for group, field, _ in tests]
    return spread(one, ("data_category", "field", "total_records", "missing_count"), rows).withColumn(
        "missing_pct", percent(F.col("missing_count"), F.col("total_records"))
    )


def field_group_grades(df: DataFrame) -> DataFrame:
    """Mean, maximum and worst field of each group with its grade (first field wins a tie)."""
    long = field_group_completeness(df)
    place = F.lit(0)
    for i, (_, field, _) in enumerate(_field_tests()):
        place = F.when(F.col("field") == field, F.lit(-i)).otherwise(place)
    return (
        long.groupBy("data_category")
        .agg(
            F.avg("missing_pct").alias("avg_missing_pct"),
            F.max("missing_pct").alias("max_missing_pct"),
            F.max_by("field", F.struct(F.col("missing_pct"), place)).alias("worst_field"),
        )
        .withColumn(
            "grade", _grade(F.col("max_missing_pct") > FIELD_LIMITS[0], F.col("max_missing_pct") > FIELD_LIMITS[1])
        )
    )


def category_consistency(df: DataFrame) -> DataFrame:
    """Sub-categories of every main category that has several, with their shares."""
    pairs = (
        df.filter(F.col("main_category").isNotNull() & F.col("sub_category").isNotNull())
        .groupBy("main_category", "sub_category")
        .agg(F.count(F.lit(1)).alias("record_count"))
    )
    totals = pairs.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("subcategory_count"), F.sum("record_count").alias("total_records")
    )
    return (
        pairs.join(totals.filter(F.col("subcategory_count") > 1), "main_category")
        .select(
            "main_category", "sub_category", "record_count", "subcategory_count",
            rounded(percent(F.col("record_count"), F.col("total_records")), 1).alias("pct_of_category"),
        )
        .orderBy(F.col("subcategory_count").desc(), "main_category", F.col("record_count").desc(), "sub_category")
    )


def category_grades(df: DataFrame) -> DataFrame:
    """Grade of each main category from its number of sub-categories and the smallest share."""
    pairs = (
        df.filter(F.col("main_category").isNotNull() & F.col("sub_category").isNotNull())
        .groupBy("main_category", "sub_category")
        .agg(F.count(F.lit(1)).alias("record_count"))
    )
    many, some = SUBCATEGORY_LIMITS
    return (
        pairs.groupBy("main_category")
        .agg(
            F.count(F.lit(1)).alias("subcategory_count"),
            percent(F.min("record_count"), F.sum("record_count")).alias("smallest_pct"),
        )
        .filter(F.col("subcategory_count") > 1)
        .withColumn(
            "grade",
            _grade(
                (F.col("subcategory_count") > many) & (F.col("smallest_pct") < SMALLEST_SHARE_LIMITS[0]),
                (F.col("subcategory_count") > some) & (F.col("smallest_pct") < SMALLEST_SHARE_LIMITS[1]),
            ),
        )
    )


def category_advice(df: DataFrame) -> DataFrame:
    """Advice lines for each main category."""
    many, some = SUBCATEGORY_LIMITS

    def lines(texts):
        return F.array(*[F.struct(F.lit(i + 1).alias("line"), F.lit(t).alias("advice")) for i, t in enumerate(texts)])

    picked = (
        F.when(F.col("subcategory_count") > many, lines(MANY_SUBCATEGORIES_ADVICE))
        .when(F.col("subcategory_count") > some, lines(SOME_SUBCATEGORIES_ADVICE))
        .otherwise(lines(FEW_SUBCATEGORIES_ADVICE))
    )
    return category_grades(df).select("main_category", "subcategory_count", F.inline(picked))
