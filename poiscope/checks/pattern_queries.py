"""Short reports."""

from __future__ import annotations

from poiscope.checks.columns import LINEITEM_COLUMNS, LOCATION_COLUMNS, union_per_column
from poiscope.checks.location_queries import OPEN, RETAIL, SCORE
from poiscope.checks.registry import query
from poiscope.functions.exprs import WEEKDAYS
from poiscope.operators import patterns as ops


def _completeness_sql(table: str, columns) -> str:
    return union_per_column(
        columns,
        f"""SELECT '{{c}}' AS column_name, count(*) AS total_records, count(*) - count({{c}}) AS missing_count,
            round(100.0 * (count(*) - count({{c}})) / count(*), 2) AS missing_percentage FROM {table}""",
    )


query("completeness_by_column", lambda t: ops.completeness_by_column(t.locations), _completeness_sql("locations", LOCATION_COLUMNS))
query(
    "completeness_by_column_lineitem",
    lambda t: ops.completeness_by_column(t.lineitem),
    _completeness_sql("lineitem", LINEITEM_COLUMNS),
    on_locations=False,
)
query(
    "business_duplicates",
    lambda t: ops.business_duplicates(t.locations),
    "SELECT name, address, count(*) AS occurrence_count FROM locations GROUP BY ALL HAVING count(*) > 1",
)
query(
    "duplicate_documents",
    lambda t: ops.business_duplicates(t.documents, ["text"]),
    "SELECT text, count(*) AS occurrence_count FROM documents GROUP BY text HAVING count(*) > 1",
    on_locations=False,
)
query(
    "category_parents",
    lambda t: ops.category_parents(t.locations),
    """SELECT sub_category AS category, count(*) AS location_count, count(DISTINCT main_category) AS parent_categories
        FROM locations GROUP BY sub_category""",
)
query(
    "category_parents_part",
    lambda t: ops.category_parents(t.part, "p_brand", "p_type"),
    """SELECT p_brand AS category, count(*) AS location_count, count(DISTINCT p_type) AS parent_categories
        FROM part GROUP BY p_brand""",
    on_locations=False,
)
query(
    "market_coverage",
    lambda t: ops.market_coverage(t.locations),
    """SELECT postal_code, count(*) AS location_count, count(DISTINCT main_category) AS category_diversity
        FROM locations GROUP BY postal_code""",
)
query(
    "confidence_levels",
    lambda t: ops.confidence_levels(t.locations),
    f"""SELECT CASE WHEN {SCORE} >= 0.9 THEN 'High' WHEN {SCORE} >= 0.7 THEN 'Medium' ELSE 'Low' END AS confidence_level,
        count(*) AS record_count FROM locations GROUP BY 1""",
)
query(
    "hours_coverage",
    lambda t: ops.hours_coverage(t.locations),
    " UNION ALL ".join(
        f"""SELECT '{d}' AS day_of_week, count(*) AS total_locations, count({d}_open) AS hours_available,
            round(100.0 * count({d}_open) / count(*), 2) AS completion_rate FROM locations"""
        for d in WEEKDAYS
    ),
)
query(
    "chains_by_name",
    lambda t: ops.chains_by_name(t.locations),
    """SELECT name, count(*) AS location_count, count(DISTINCT postal_code) AS postal_codes_covered
        FROM locations GROUP BY name HAVING count(*) >= 5""",
)
query(
    "postal_formats",
    lambda t: ops.postal_formats(t.locations),
    r"""SELECT CASE WHEN regexp_full_match(postal_code, '\d{5}') THEN '5-digit'
        WHEN regexp_full_match(postal_code, '\d{5}-\d{4}') THEN '9-digit' ELSE 'other' END AS postal_code_format,
        count(*) AS occurrence_count FROM locations GROUP BY 1""",
)
query(
    "confidence_summary",
    lambda t: ops.confidence_summary(t.locations),
    f"""SELECT round(avg({SCORE}), 6) AS avg_score,
        round(100.0 * count(*) FILTER (WHERE {SCORE} < 0.7) / count(*), 6) AS low_pct,
        round(100.0 * count(*) FILTER (WHERE {SCORE} > 0.9) / count(*), 6) AS high_pct FROM locations""",
)
query(
    "hierarchy_cardinality",
    lambda t: ops.hierarchy_cardinality(t.locations),
    """SELECT count(DISTINCT main_category) AS main_categories, count(DISTINCT sub_category) AS sub_categories,
        (SELECT count(*) FROM (SELECT DISTINCT main_category, sub_category FROM locations
            WHERE main_category IS NOT NULL AND sub_category IS NOT NULL)) AS full_hierarchies FROM locations""",
)
query(
    "open_retail_share",
    lambda t: ops.open_retail_share(t.locations),
    f"""SELECT count(*) AS total_locations, count(*) FILTER (WHERE {OPEN} AND {RETAIL}) AS open_retail_locations,
        round(100.0 * count(*) FILTER (WHERE {OPEN} AND {RETAIL}) / count(*), 2) AS open_retail_pct FROM locations""",
)
query(
    "city_share",
    lambda t: ops.city_share(t.locations),
    f"""SELECT city, count(*) AS location_count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS city_pct
        FROM locations WHERE {OPEN} AND {RETAIL} GROUP BY city""",
)
query(
    "top_chains",
    lambda t: ops.top_chains(t.locations),
    f"""SELECT chain_name, count(*) AS location_count FROM locations WHERE {OPEN} AND {RETAIL} AND chain_name IS NOT NULL
        GROUP BY chain_name ORDER BY location_count DESC, chain_name LIMIT 10""",
)


def _suspects_sql(table: str, column: str) -> str:
    test = f"regexp_matches({column}, '{ops.GARBLED}')"
    return f"""SELECT count(*) AS row_count, count(*) FILTER (WHERE {test}) AS suspect_count,
        round(100.0 * count(*) FILTER (WHERE {test}) / count(*), 2) AS suspect_pct FROM {table}"""


query("encoding_suspects", lambda t: ops.encoding_suspects(t.locations), _suspects_sql("locations", "name"))
query(
    "encoding_suspects_documents",
    lambda t: ops.encoding_suspects(t.documents, "text"),
    _suspects_sql("documents", "text"),
    on_locations=False,
)
query(
    "encoding_suspect_rows_documents",
    lambda t: ops.encoding_suspect_rows(t.documents, "text").select("doc_id"),
    f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{ops.GARBLED}')",
    on_locations=False,
)
query(
    "encoding_suspect_rows_garbled",
    lambda t: ops.encoding_suspect_rows(t.documents.selectExpr("doc_id", "replace(text, 'é', 'Ã©') AS text"), "text"),
    f"""SELECT doc_id, replace(text, 'é', 'Ã©') AS text FROM documents
        WHERE regexp_matches(replace(text, 'é', 'Ã©'), '{ops.GARBLED}')""",
    on_locations=False,
)
