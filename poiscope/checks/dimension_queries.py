"""Quality metrics per dimension with grades."""

from __future__ import annotations

from poiscope.checks.location_queries import CHAIN, OPEN, RETAIL, SCORE
from poiscope.checks.registry import query
from poiscope.operators import dimension_quality as ops


def _share(test: str) -> str:
    return f"count(*) FILTER (WHERE {test}) * 100.0 / count(*)"


def _grade(critical: str, warning: str) -> str:
    return f"CASE WHEN {critical} THEN 'critical' WHEN {warning} THEN 'warning' ELSE 'good' END AS grade"


query(
    "distribution_quality",
    lambda t: ops.distribution_quality(t.locations),
    f"""WITH m AS (SELECT main_category, count(*) AS total_locations, round(avg({SCORE}) * 100, 1) AS avg_confidence_score,
        {_share('address IS NULL')} AS missing_address_pct, {_share('monday_open IS NULL')} AS missing_hours_pct,
        {_share(SCORE + ' < 0.7')} AS low_confidence_pct FROM locations WHERE {OPEN} AND {RETAIL} GROUP BY main_category)
    SELECT *, {_grade('missing_address_pct > 10 OR missing_hours_pct > 50 OR low_confidence_pct > 30',
                      'missing_address_pct > 5 OR missing_hours_pct > 30 OR low_confidence_pct > 20')} FROM m""",
)
query(
    "chain_consistency",
    lambda t: ops.chain_consistency(t.locations),
    f"""WITH m AS (SELECT chain_name, count(*) AS location_count, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities,
        min({SCORE}) AS min_confidence, max({SCORE}) AS max_confidence, avg({SCORE}) AS avg_confidence,
        max({SCORE}) - min({SCORE}) AS confidence_range
        FROM locations WHERE {CHAIN} AND {OPEN} AND {RETAIL} GROUP BY chain_name HAVING count(*) >= 3)
    SELECT *, {_grade('confidence_range > 0.3 OR min_confidence < 0.5', 'confidence_range > 0.2 OR min_confidence < 0.7')}
    FROM m ORDER BY confidence_range DESC, location_count DESC, chain_name NULLS LAST LIMIT 10""",
)
query(
    "geographic_quality",
    lambda t: ops.geographic_quality(t.locations),
    f"""WITH m AS (SELECT city, count(*) AS total_locations, round(avg({SCORE}) * 100, 1) AS avg_confidence_score,
        {_share('latitude IS NULL OR longitude IS NULL')} AS missing_coordinates_pct,
        {_share('address IS NULL')} AS missing_address_pct, {_share(SCORE + ' < 0.7')} AS low_confidence_pct
        FROM locations WHERE {OPEN} GROUP BY city HAVING count(*) >= 10)
    SELECT *, {_grade('missing_coordinates_pct > 10 OR missing_address_pct > 10 OR low_confidence_pct > 30',
                      'missing_coordinates_pct > 5 OR missing_address_pct > 5 OR low_confidence_pct > 20')}
    FROM m ORDER BY avg_confidence_score, city NULLS LAST LIMIT 10""",
)

FIELDS = [
    ("Contact Information", "phone", "phone IS NULL"),
    ("Contact Information", "website", "website IS NULL"),
    ("Contact Information", "email", "email IS NULL"),
    ("Location Data", "address", "address IS NULL"),
    ("Location Data", "coordinates", "latitude IS NULL OR longitude IS NULL"),
    ("Location Data", "postal", "postal_code IS NULL"),
    ("Business Information", "category", "main_category IS NULL"),
    ("Business Information", "hours", "monday_open IS NULL"),
    ("Business Information", "opened_date", "opened_on IS NULL"),
]
FIELD_SQL = " UNION ALL ".join(
    f"""SELECT '{group}' AS data_category, '{field}' AS field, count(*) AS total_records,
        count(*) FILTER (WHERE {test}) AS missing_count, {_share(test)} AS missing_pct FROM locations WHERE {OPEN}"""
    for group, field, test in FIELDS
)
query("field_group_completeness", lambda t: ops.field_group_completeness(t.locations), FIELD_SQL)
query(
    "field_group_grades",
    lambda t: ops.field_group_grades(t.locations).selectExpr(
        "data_category", "round(avg_missing_pct, 6) AS avg_missing_pct", "max_missing_pct", "worst_field", "grade"
    ),
    f"""WITH f AS ({FIELD_SQL}),
    m AS (SELECT data_category, round(avg(missing_pct), 6) AS avg_missing_pct, max(missing_pct) AS max_missing_pct,
        arg_max(field, missing_pct) AS worst_field FROM f GROUP BY data_category)
    SELECT *, {_grade('max_missing_pct > 50', 'max_missing_pct > 25')} FROM m""",
)

PAIRS = """pairs AS (SELECT main_category, sub_category, count(*) AS record_count FROM locations
    WHERE main_category IS NOT NULL AND sub_category IS NOT NULL GROUP BY ALL)"""
query(
    "category_consistency",
    lambda t: ops.category_consistency(t.locations),
    f"""WITH {PAIRS}, shares AS (SELECT *, count(*) OVER (PARTITION BY main_category) AS subcategory_count,
        round(record_count * 100.0 / sum(record_count) OVER (PARTITION BY main_category), 1) AS pct_of_category FROM pairs)
    SELECT main_category, sub_category, record_count, subcategory_count, pct_of_category FROM shares WHERE subcategory_count > 1""",
)
GRADES = f"""WITH {PAIRS}, m AS (SELECT main_category, count(*) AS subcategory_count,
    min(record_count) * 100.0 / sum(record_count) AS smallest_pct FROM pairs GROUP BY main_category HAVING count(*) > 1),
    graded AS (SELECT *, {_grade('subcategory_count > 10 AND smallest_pct < 1', 'subcategory_count > 5 AND smallest_pct < 5')} FROM m)"""
query("category_grades", lambda t: ops.category_grades(t.locations), f"{GRADES} SELECT * FROM graded")


def _advice_rows(condition: str, texts) -> str:
    return " UNION ALL ".join(
        f"SELECT main_category, subcategory_count, {i + 1} AS line, '{text}' AS advice FROM graded WHERE {condition}"
        for i, text in enumerate(texts)
    )


query(
    "category_advice",
    lambda t: ops.category_advice(t.locations),
    GRADES
    + " UNION ALL ".join(
        [
            _advice_rows("subcategory_count > 10", ops.MANY_SUBCATEGORIES_ADVICE),
            _advice_rows("subcategory_count > 5 AND subcategory_count <= 10", ops.SOME_SUBCATEGORIES_ADVICE),
            _advice_rows("subcategory_count <= 5", ops.FEW_SUBCATEGORIES_ADVICE),
        ]
    ),
)
