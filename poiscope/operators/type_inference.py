"""What the values of each column appear to be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from poiscope.functions.exprs import NUMERIC_TYPES, TEMPORAL_TYPES, missing_sql, present_sql, quoted, text_literal
from poiscope.plans.distincts import few_valued, value_counts
from poiscope.plans.fused import Facts
from poiscope.plans.leading import leading_values

# The text patterns; `date` needs one matching value, the others all of them.
DATE_TEXT = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"
PHONE_TEXT = r"^\+?[0-9\s\(\)-]{7,20}$"
EMAIL_TEXT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_TEXT = r"^https?://(?:[-\w.]|(?:%[0-9a-fA-F]{2}))+"
PATTERNS = {"any_date": DATE_TEXT, "all_phone": PHONE_TEXT, "all_email": EMAIL_TEXT, "all_url": URL_TEXT}
CATEGORICAL_BELOW = 20
CATEGORICAL_RATIO = 0.1
SHOWN_CATEGORIES = 10
SHOWN_SAMPLES = 5
SCANNED = {
    "column": "string", "position": "int", "row_count": "bigint", "missing_count": "bigint", "min_value": "double",
    "max_value": "double", "mean_value": "double", "some": "int", "every": "int",
}


def detect_types(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Engine type, inferred type, samples and, by kind, range or categories of each column.

    For text the strongest rule wins: categorical, then url, email, phone number, date, text.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in df.columns if isinstance(kinds[c], T.StringType)]
    facts = Facts(df, SCANNED)
    rows = facts.term("count(1)")
    for i, c in enumerate(df.columns):
        gaps = facts.term(f"count_if({missing_sql(df, c)})")
        told = {"column": text_literal(c), "position": str(i), "row_count": rows, "missing_count": gaps}
        if isinstance(kinds[c], NUMERIC_TYPES):
            told |= {f"{label}_value": facts.term(f"CAST({f}({present_sql(df, c)}) AS DOUBLE)") for label, f in (("min", "min"), ("max", "max"), ("mean", "avg"))}
        if c in text:
            # Which patterns a value has, as bits: any value's, and all values'.
            v = quoted(c)
            bits = " + ".join(f"CAST({v} RLIKE {text_literal(p)} AS INT) * {1 << k}" for k, p in enumerate(PATTERNS.values()))
            told |= {"some": facts.term(f"bit_or({bits})"), "every": facts.term(f"bit_and({bits})")}
        facts.row([t for f, t in told.items() if f not in ("column", "position")], "true", **told)
    has = lambda bits, label: (F.coalesce(F.getbit(bits, F.lit(list(PATTERNS).index(label))), F.lit(0)) == 1).alias(label)
    scanned = facts.frame().select(
        "column", "position", "row_count", "missing_count", "min_value", "max_value", "mean_value",
        has("some", "any_date"), *[has("every", label) for label in ("all_phone", "all_email", "all_url")],
    )

    few = few_valued(df, text, CATEGORICAL_BELOW)
    listed = F.slice(F.array_sort(F.collect_list("value")), 1, SHOWN_CATEGORIES)
    # Only columns estimated at a few dozen values get here, so the list stays that short.
    categories = (
        value_counts(df, few)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct_count"), F.array_join(listed, ", ").alias("first_categories"))
    )
    samples = leading_values(df, df.columns, order_by, SHOWN_SAMPLES)

    types = F.create_map(*[x for name, kind in df.dtypes for x in (F.lit(name), F.lit(kind))])
    base_kind = F.create_map(
        *[
            x
            for c, kind in kinds.items()
            for x in (
                F.lit(c),
                F.lit(
                    "datetime" if isinstance(kind, TEMPORAL_TYPES)
                    else "numeric" if isinstance(kind, NUMERIC_TYPES)
                    else "boolean" if isinstance(kind, T.BooleanType)
                    else "text" if isinstance(kind, T.StringType)
                    else "unknown"
                ),
            )
        ]
    )
    filled = F.col("row_count") - F.col("missing_count")
    categorical = (F.col("distinct_count") < CATEGORICAL_BELOW) & (
        F.try_divide(F.col("distinct_count").cast("double"), filled.cast("double")) < CATEGORICAL_RATIO
    )
    is_text = F.col("base_kind") == "text"
    inferred = (
        F.when(filled == 0, "empty")
        .when(~is_text, F.col("base_kind"))
        .when(categorical, "categorical")
        .when(F.col("all_url"), "url")
        .when(F.col("all_email"), "email")
        .when(F.col("all_phone"), "phone_number")
        .when(F.col("any_date"), "date_string")
        .otherwise("text")
    )
    is_categorical = F.col("inferred_type") == "categorical"
    return (
        scanned.join(categories, "column", "left")
        .join(samples, "column", "left")
        .withColumn("base_kind", base_kind[F.col("column")])
        .withColumn("inferred_type", inferred)
        .select(
            "column", "position",
            types[F.col("column")].alias("engine_type"),
            "inferred_type",
            (F.col("missing_count") > 0).alias("contains_nulls"),
            F.col("samples").alias("sample_values"),
            "min_value", "max_value", "mean_value",
            F.when(is_categorical, F.col("first_categories")).alias("categories"),
            F.when(is_categorical, F.col("distinct_count")).alias("category_count"),
        )
    )
