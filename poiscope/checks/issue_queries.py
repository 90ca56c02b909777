"""Issue detection, grades, scores and recommendations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from poiscope.checks.columns import LINEITEM_COLUMNS, LOCATION_COLUMNS, LOCATION_TYPES, union_per_column
from poiscope.checks.profile_queries import SCORE, SCORE_VALUE, duplicates_sql, keys_sql, missing_sql
from poiscope.checks.registry import query
from poiscope.functions import roles
from poiscope.operators import grading, issues as ops, profile

TEXT = [c for c, k in LOCATION_TYPES.items() if k == "string"]
NUMBERS = [c for c, k in LOCATION_TYPES.items() if k in ("double", "bigint")]
CRITICAL = roles.resolve(LOCATION_COLUMNS, "critical")

CRITICAL_SQL = f"""SELECT "column", missing_count, missing_pct FROM ({missing_sql('locations', CRITICAL)}) WHERE missing_count > 0"""
query("critical_missing", lambda t: ops.critical_missing(t.locations), CRITICAL_SQL)
query(
    "duplicate_issue",
    lambda t: ops.duplicate_issue(t.locations),
    f"SELECT * FROM ({duplicates_sql('locations')}) WHERE duplicate_count > 0",
)


def _few_sql(table: str, columns) -> str:
    return union_per_column(
        columns,
        f"""SELECT '{{c}}' AS "column", count(DISTINCT {{c}}) AS distinct_count FROM {table}
            HAVING count(DISTINCT {{c}}) BETWEEN 2 AND 14""",
    )


query("numeric_as_categorical", lambda t: ops.numeric_as_categorical(t.locations), _few_sql("locations", NUMBERS))
query(
    "numeric_as_categorical_lineitem",
    lambda t: ops.numeric_as_categorical(t.lineitem),
    _few_sql("lineitem", LINEITEM_COLUMNS[:8]),
    on_locations=False,
)


def _first_sql(table: str, columns, order: str, test: str) -> str:
    return union_per_column(
        columns,
        f"""SELECT "column", first_value FROM (SELECT '{{c}}' AS "column", CAST(arg_min({{c}}, {order}) AS VARCHAR) AS first_value
            FROM {table} WHERE {{c}} IS NOT NULL) WHERE {test}""",
    )


IDENTIFIERS = [c for c in NUMBERS if roles.matches(c, "identifier")]
query(
    "id_leading_zero",
    lambda t: ops.id_leading_zero(t.locations, ["location_id"]),
    _first_sql("locations", IDENTIFIERS, "location_id", "starts_with(first_value, '0')"),
)
query(
    "date_as_text",
    lambda t: ops.date_as_text(t.locations, ["location_id"]),
    _first_sql(
        "locations", [c for c in TEXT if roles.matches(c, "temporal")], "location_id",
        "regexp_matches(first_value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')",
    ),
)
MAYBE_NUMBERS = [c for c in TEXT if not roles.matches(c, "never_numeric_text")]
NUMBER_SQL = union_per_column(
    MAYBE_NUMBERS,
    """SELECT *, round(digits_count / value_count, 6) AS digits_share FROM (SELECT '{c}' AS "column",
        count(*) FILTER (WHERE regexp_full_match(replace({c}, '.', ''), '[0-9]+')) AS digits_count, count({c}) AS value_count
        FROM locations) WHERE digits_count / value_count > 0.8""",
)
query("number_as_text", lambda t: ops.number_as_text(t.locations), NUMBER_SQL)
ZERO_SQL = _first_sql("locations", IDENTIFIERS, "location_id", "starts_with(first_value, '0')")
DATE_SQL = _first_sql(
    "locations", [c for c in TEXT if roles.matches(c, "temporal")], "location_id",
    "regexp_matches(first_value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')",
)
TYPE_SQL = f"""SELECT "column", arg_max(issue_type, rule) AS issue_type FROM (
    SELECT "column", 1 AS rule, 'numeric_as_categorical' AS issue_type FROM ({_few_sql('locations', NUMBERS)})
    UNION ALL SELECT "column", 2, 'id_leading_zero' FROM ({ZERO_SQL})
    UNION ALL SELECT "column", 3, 'date_as_text' FROM ({DATE_SQL})
    UNION ALL SELECT "column", 4, 'number_as_text' FROM ({NUMBER_SQL})) GROUP BY "column\""""
query("type_issues", lambda t: ops.type_issues(t.locations, ["location_id"]), TYPE_SQL)


def _outlier_sql(table: str, columns, money) -> str:
    rows = []
    for c in columns:
        out = f"{c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"
        impact = ", ".join(
            (f"round({f}({c}) FILTER (WHERE {out}), 4)" if c in money else "CAST(NULL AS DOUBLE)") + f" AS impact_{n}"
            for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("sum", "total"))
        )
        rows.append(
            f"""SELECT '{c}' AS "column", q1, q3, count(*) FILTER (WHERE {out}) AS outlier_count, {impact}
            FROM {table}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {table})
            GROUP BY q1, q3 HAVING count(*) FILTER (WHERE {out}) > 0"""
        )
    return "\nUNION ALL ".join(rows)


def _rounded_impact(df):
    keep = [c for c in df.columns if not c.startswith("impact_")]
    return df.select(*keep, *[F.round(c, 4).alias(c) for c in df.columns if c.startswith("impact_")])


CHECKED = [c for c in NUMBERS if not roles.matches(c, "outlier_exempt")]
query(
    "iqr_outliers",
    lambda t: _rounded_impact(ops.iqr_outliers(t.locations)),
    _outlier_sql("locations", CHECKED, {"price_amount"}),
)
query(
    "iqr_outliers_lineitem",
    lambda t: _rounded_impact(ops.iqr_outliers(t.lineitem)),
    _outlier_sql("lineitem", LINEITEM_COLUMNS[:8], {"l_extendedprice", "l_quantity"}),
    on_locations=False,
)
query(
    "iqr_outliers_orders",
    lambda t: _rounded_impact(ops.iqr_outliers(t.orders, ["o_totalprice"])),
    _outlier_sql("orders", ["o_totalprice"], {"o_totalprice"}),
    on_locations=False,
)
query(
    "json_text_columns",
    lambda t: ops.json_text_columns(t.locations, ["location_id"]).select("column"),
    union_per_column(
        TEXT,
        """SELECT "column" FROM (SELECT '{c}' AS "column", arg_min({c}, location_id) AS v FROM locations WHERE {c} IS NOT NULL)
        WHERE v LIKE '{{%}}' AND json_valid(v)""",
    ),
)
query(
    "json_text_columns_events",
    lambda t: ops.json_text_columns(t.events, ["event_id"]).select("column"),
    """SELECT 'props' AS "column" FROM (SELECT arg_min(props, event_id) AS v FROM events) WHERE v LIKE '{%}' AND json_valid(v)""",
    on_locations=False,
)


def _hierarchy_sql(table: str, columns) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{a}' AS parent_column, '{b}' AS child_column, {a} AS parent, count(DISTINCT {b}) AS child_count
        FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a} HAVING count(DISTINCT {b}) > 1"""
        for a, b in combinations(columns, 2)
    )


SUMMARY = """SELECT parent_column, child_column, count(*) AS inconsistent_parents,
    string_agg(parent, ', ' ORDER BY parent) FILTER (WHERE place <= 10) AS first_parents
    FROM (SELECT *, row_number() OVER (PARTITION BY parent_column, child_column ORDER BY parent) AS place FROM ({detail}))
    GROUP BY parent_column, child_column"""
LOCATION_CATEGORIES = roles.resolve(LOCATION_COLUMNS, "hierarchy")
LOCATION_HIERARCHY = _hierarchy_sql("locations", LOCATION_CATEGORIES)
PART_HIERARCHY = _hierarchy_sql("part", ["p_type", "p_brand", "p_name"])
query("category_hierarchy", lambda t: ops.category_hierarchy(t.locations), LOCATION_HIERARCHY)
query("category_hierarchy_summary", lambda t: ops.category_hierarchy_summary(t.locations), SUMMARY.format(detail=LOCATION_HIERARCHY))
query(
    "category_hierarchy_part",
    lambda t: ops.category_hierarchy_summary(t.part, ["p_type", "p_brand", "p_name"]),
    SUMMARY.format(detail=PART_HIERARCHY),
    on_locations=False,
)

ADDRESS = roles.resolve(LOCATION_COLUMNS, "address_part")
GEO = roles.resolve(LOCATION_COLUMNS, "geo")


def _hits_sql(kind: str, column: str, test: str) -> str:
    return f"""SELECT '{kind}' AS issue_type, '{column}' AS "column", count(*) AS affected_rows FROM locations
        WHERE {test} HAVING count(*) > 0"""


LOCATION_SQL = "\nUNION ALL ".join(
    [_hits_sql("empty_text", c, f"{c} = ''") for c in ADDRESS if c in TEXT]
    + [_hits_sql("short_text", c, f"length({c}) < 8 AND {c} <> ''") for c in ADDRESS if c in TEXT]
    + [_hits_sql("geo_missing_with_address", g, f"{ADDRESS[0]} <> '' AND {g} IS NULL") for g in GEO]
)
query("location_issues", lambda t: ops.location_issues(t.locations), LOCATION_SQL)
GAPS_SQL = f"""SELECT * FROM ({missing_sql('locations', LOCATION_COLUMNS)}) WHERE missing_count > 0"""
OUTLIER_SQL = _outlier_sql("locations", CHECKED, {"price_amount"})
JSON_SQL = union_per_column(
    TEXT,
    """SELECT "column" FROM (SELECT '{c}' AS "column", arg_min({c}, location_id) AS v FROM locations WHERE {c} IS NOT NULL)
    WHERE v LIKE '{{%}}' AND json_valid(v)""",
)
FOUND = f"""WITH gaps AS ({GAPS_SQL}), outliers AS ({OUTLIER_SQL}),
    found AS (SELECT 'missing_values' AS family, 'missing_values' AS issue_type, "column", NULL::VARCHAR AS detail, missing_count::DOUBLE AS value FROM gaps
    UNION ALL SELECT 'critical_missing_fields', 'critical_missing', "column", NULL, missing_count FROM ({CRITICAL_SQL})
    UNION ALL SELECT 'duplicate_rows', 'duplicate_rows', NULL, NULL, duplicate_count FROM ({duplicates_sql('locations')}) WHERE duplicate_count > 0
    UNION ALL SELECT 'type_issues', issue_type, "column", NULL, NULL FROM ({TYPE_SQL})
    UNION ALL SELECT 'outliers', 'iqr_outliers', "column", NULL, outlier_count FROM outliers
    UNION ALL SELECT 'outlier_impact', 'outlier_impact', "column", NULL, impact_total FROM outliers WHERE impact_total IS NOT NULL
    UNION ALL SELECT 'json_columns', 'json_text', "column", NULL, NULL FROM ({JSON_SQL})
    UNION ALL SELECT 'category_hierarchy_issues', 'category_hierarchy', parent_column || '_to_' || child_column, first_parents, inconsistent_parents
        FROM ({SUMMARY.format(detail=LOCATION_HIERARCHY)})
    UNION ALL SELECT 'potential_primary_keys', 'key_candidate', "column", NULL, distinct_count
        FROM ({keys_sql('(SELECT DISTINCT * FROM locations)', LOCATION_COLUMNS)})
        WHERE (SELECT duplicate_count FROM ({duplicates_sql('locations')})) > 0
    UNION ALL SELECT 'location_data_issues', issue_type, "column", NULL, affected_rows FROM ({LOCATION_SQL}))"""
query(
    "find_issues",
    # The inferred JSON schema has no SQL counterpart, and sums of doubles are compared to four places.
    lambda t: ops.find_issues(t.locations, ["location_id"]).selectExpr(
        "family", "issue_type", "column", "CASE WHEN family <> 'json_columns' THEN detail END AS detail", "round(value, 4) AS value"
    ),
    FOUND + ' SELECT family, issue_type, "column", detail, round(value, 4) AS value FROM found',
)

# --- grades -----------------------------------------------------------------------------------

LEVELS = "CASE WHEN {p} > {a} THEN 'critical' WHEN {p} > {b} THEN 'warning' WHEN {p} > 0 THEN 'info' END"
NAMES = "CASE level WHEN 'critical' THEN '{0}igh' WHEN 'warning' THEN '{1}edium' ELSE '{2}ow' END"
MIXED_TEXT = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", {LOCATION_COLUMNS.index(c)} AS position,
    (bool_or(regexp_matches({c}, '{profile.VALUE_CLASSES['number']}')))::INT + (bool_or(regexp_matches({c}, '{profile.VALUE_CLASSES['date']}')))::INT
    + (bool_or(regexp_matches({c}, '{profile.VALUE_CLASSES['boolean']}')))::INT
    + (bool_or({c} <> '' AND NOT regexp_matches({c}, '{profile.VALUE_CLASSES['number']}') AND NOT regexp_matches({c}, '{profile.VALUE_CLASSES['date']}')
        AND NOT regexp_matches({c}, '{profile.VALUE_CLASSES['boolean']}')))::INT AS kinds FROM locations"""
    for c in TEXT
)
ISSUES = f"""WITH m AS ({missing_sql('locations', LOCATION_COLUMNS)}), d AS ({duplicates_sql('locations')}), x AS ({MIXED_TEXT}),
    g AS (SELECT *, {LEVELS.format(p='missing_pct', a=20, b=5)} AS level FROM m),
    h AS (SELECT *, {LEVELS.format(p='duplicate_pct', a=10, b=1)} AS level FROM d),
    issues AS (
        SELECT level, {NAMES.format('h', 'm', 'l')} || '_missing_values' AS type,
            {NAMES.format('H', 'M', 'L')} || ' percentage of missing values in column ' || "column" || printf(': %.2f%%', missing_pct) AS description,
            "column" AS affected_columns, position FROM g WHERE level IS NOT NULL
        UNION ALL SELECT level, {NAMES.format('h', 'm', 'l')} || '_duplicate_rows',
            {NAMES.format('H', 'M', 'L')} || printf(' percentage of duplicate rows: %.2f%%', duplicate_pct), '', -1 FROM h WHERE level IS NOT NULL
        UNION ALL SELECT 'warning', 'mixed_data_types', 'Mixed data types detected in ' || count(*) || ' columns',
            string_agg("column", ', ' ORDER BY position), -1 FROM x WHERE kinds > 1 HAVING count(*) > 0)"""


def _graded(t):
    return grading.graded_issues(t.locations)


query(
    "graded_issues",
    lambda t: _graded(t).select("level", "type", "description", F.array_join("affected_columns", ", ").alias("affected_columns")),
    ISSUES + " SELECT level, type, description, affected_columns FROM issues",
)
WEIGHT = "CASE level WHEN 'critical' THEN 10.0::DOUBLE WHEN 'warning' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END"
query(
    "issue_deductions",
    lambda t: grading.deductions(_graded(t)),
    ISSUES + f" SELECT type AS reason, {WEIGHT} AS deduction, description AS details FROM issues",
)
query(
    "issue_score",
    lambda t: grading.issue_score(_graded(t)),
    ISSUES + f" SELECT greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - coalesce(sum({WEIGHT}), 0))) AS score FROM issues",
)
query(
    "issue_breakdown",
    lambda t: grading.issue_breakdown(_graded(t)),
    ISSUES
    + " UNION ALL ".join(
        f" SELECT '{s}' AS severity, count(*) FILTER (WHERE level = '{s}') AS count FROM issues" for s in grading.SEVERITY_WEIGHTS
    ),
)
query(
    "column_scores",
    lambda t: grading.column_scores(t.locations),
    f"""SELECT "column", 100.0 - missing_pct AS score FROM ({missing_sql('locations', LOCATION_COLUMNS)})""",
)
ADVICE_SQL = f"""lines AS (
        SELECT 1 AS k, '{grading.DROP_COLUMNS}' || string_agg(affected_columns, ', ' ORDER BY position) AS recommendation
            FROM issues WHERE type = 'high_missing_values' HAVING count(*) > 0
        UNION ALL SELECT 2, '{grading.IMPUTE_COLUMNS}' || string_agg(affected_columns, ', ' ORDER BY position)
            FROM issues WHERE type = 'medium_missing_values' HAVING count(*) > 0
        UNION ALL SELECT 3, '{grading.REMOVE_DUPLICATES}' FROM issues WHERE type = 'high_duplicate_rows'
        UNION ALL SELECT 4, '{grading.STANDARDIZE_TYPES}' || affected_columns FROM issues WHERE type = 'mixed_data_types'
        UNION ALL SELECT 5, '{grading.PROFILE_MORE}' FROM issues HAVING count(*) > 0
        UNION ALL SELECT 6, '{grading.DOCUMENT_ISSUES}' FROM issues HAVING count(*) > 0)"""
query(
    "recommend_operations",
    lambda t: grading.recommend_operations(_graded(t)),
    f"{ISSUES}, {ADVICE_SQL} SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, recommendation FROM lines",
)
query(
    "quality_report",
    lambda t: grading.quality_report(t.locations, "locations").select(
        "table_name", "quality_score",
        F.expr("issues_summary['critical']").alias("critical"), F.expr("issues_summary['warning']").alias("warning"),
        F.expr("issues_summary['info']").alias("info"), F.expr("column_quality['address']").alias("address_score"),
        F.size("column_quality").cast("long").alias("scored_columns"), F.array_join("recommendations", "; ").alias("recommendations"),
    ),
    f"""{ISSUES}, {ADVICE_SQL}
    SELECT 'locations' AS table_name, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - coalesce(sum({WEIGHT}), 0))) AS quality_score,
        count(*) FILTER (WHERE level = 'critical') AS critical, count(*) FILTER (WHERE level = 'warning') AS warning,
        count(*) FILTER (WHERE level = 'info') AS info, (SELECT 100.0 - missing_pct FROM m WHERE "column" = 'address') AS address_score,
        (SELECT count(*) FROM m) AS scored_columns, (SELECT string_agg(recommendation, '; ' ORDER BY k) FROM lines) AS recommendations
    FROM issues""",
)
query(
    "key_metrics",
    lambda t: grading.key_metrics(t.locations),
    ISSUES.replace("WITH m AS", SCORE.replace("WITH m AS", "WITH sm AS").replace("FROM m)", "FROM sm)").replace("d AS", "sd AS") + ", m AS", 1)
    + f""" SELECT {SCORE_VALUE} AS quality_score, (SELECT count(*) FROM issues WHERE level = 'critical') AS critical_issues,
        round_even(100.0 - miss, 1) AS completeness FROM o, sd""",
)
query(
    "score_bands",
    lambda t: grading.column_scores(t.locations).withColumn("band", grading.score_band(F.col("score"))),
    f"""SELECT "column", 100.0 - missing_pct AS score, CASE WHEN missing_pct >= 50 THEN 'red' WHEN missing_pct >= 25 THEN 'orange' ELSE 'green' END AS band
        FROM ({missing_sql('locations', LOCATION_COLUMNS)})""",
)
SAID = """CASE family WHEN 'missing_values' THEN 'Found ' || n || ' columns with missing values'
    WHEN 'critical_missing_fields' THEN 'Found ' || n || ' critical columns with missing values'
    WHEN 'duplicate_rows' THEN 'Found ' || CAST(total AS BIGINT) || ' duplicate rows'
    WHEN 'potential_primary_keys' THEN 'Consider using one of these columns as a primary key: ' || array_to_string(names[1:3], ', ')
    WHEN 'type_issues' THEN 'Found ' || n || ' columns with potential data type issues'
    WHEN 'outliers' THEN 'Found outliers in ' || n || ' numeric columns'
    WHEN 'outlier_impact' THEN 'Found outliers in ' || n || ' price or quantity columns with potential business impact'
    WHEN 'json_columns' THEN 'Found ' || n || ' columns with JSON data stored as strings'
    WHEN 'category_hierarchy_issues' THEN 'Found ' || n || ' inconsistent category relationships'
    ELSE 'Found issues with location/address data' END"""
RULES = ", ".join(
    "({}, '{}', '{}', '{}')".format(i + 1, family, title, "; ".join(actions)) for i, (family, (title, actions)) in enumerate(grading.ADVICE.items())
)
query(
    "cleaning_recommendations",
    lambda t: grading.cleaning_recommendations(ops.find_issues(t.locations, ["location_id"])).withColumn(
        "actions", F.array_join("actions", "; ")
    ),
    f"""{FOUND}, counted AS (SELECT family, count(*) AS n, sum(value) AS total, list_sort(list_distinct(list("column"))) AS names FROM found GROUP BY family)
    SELECT position, title AS issue, {SAID} AS description, actions
    FROM counted JOIN (VALUES {RULES}) AS r(position, family, title, actions) USING (family)""",
)
