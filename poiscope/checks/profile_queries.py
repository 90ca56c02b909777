"""Table profile and type inference."""

from __future__ import annotations

from poiscope.checks.columns import LINEITEM_COLUMNS, LINEITEM_TYPES, LOCATION_COLUMNS, LOCATION_TYPES, union_per_column
from poiscope.checks.registry import query
from poiscope.operators import profile as ops
from poiscope.operators.type_inference import detect_types

NOT_NULL_TEXT = [c for c, k in LOCATION_TYPES.items() if k == "string"]
NUMBERS = [c for c, k in LOCATION_TYPES.items() if k in ("double", "bigint")]
WIDTHS = {"bigint": 8, "int": 4, "double": 8, "date": 4, "timestamp_ntz": 8}


def pct(part: str, whole: str = "count(*)") -> str:
    return f"round_even(({part}) * 100.0 / nullif({whole}, 0), 2)"


def basic_sql(table: str, types: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS position, '{k}' AS type, count(*) AS row_count, {len(types)} AS column_count FROM {table}"""
        for i, (c, k) in enumerate(types.items())
    )


def missing_sql(table: str, columns) -> str:
    return union_per_column(
        columns,
        f"""SELECT '{{c}}' AS "column", {{i}} AS position, count(*) AS row_count, count(*) - count({{c}}) AS missing_count,
            {pct('count(*) - count({c})')} AS missing_pct FROM {table}""",
    )


query("basic_stats", lambda t: ops.basic_stats(t.locations), basic_sql("locations", LOCATION_TYPES))
query("basic_stats_lineitem", lambda t: ops.basic_stats(t.lineitem), basic_sql("lineitem", LINEITEM_TYPES), on_locations=False)
query("missing_values", lambda t: ops.missing_values(t.locations), missing_sql("locations", LOCATION_COLUMNS))
query("missing_values_lineitem", lambda t: ops.missing_values(t.lineitem), missing_sql("lineitem", LINEITEM_COLUMNS), on_locations=False)

OVERALL = f"""WITH m AS ({missing_sql('locations', LOCATION_COLUMNS)})
    SELECT max(row_count) AS row_count, count(*) AS column_count, CAST(sum(missing_count) AS BIGINT) AS missing_cells,
    {pct('sum(missing_count)', 'sum(row_count)')} AS overall_missing_pct FROM m"""
query("overall_missing", lambda t: ops.overall_missing(t.locations), OVERALL)


def duplicates_sql(table: str) -> str:
    return f"""SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicate_count,
        {pct(f'count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))')} AS duplicate_pct FROM {table}"""


query("duplicate_rows", lambda t: ops.duplicate_rows(t.locations), duplicates_sql("locations"))
for _table in ("lineitem", "events", "documents", "embeddings"):
    query(f"duplicate_rows_{_table}", lambda t, n=_table: ops.duplicate_rows(getattr(t, n)), duplicates_sql(_table), on_locations=False)
query(
    "duplicate_document_contents",
    lambda t: ops.duplicate_rows(t.documents.select("text", "lang")),
    duplicates_sql("(SELECT text, lang FROM documents)"),
    on_locations=False,
)

VALID = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
query(
    "coordinate_validity",
    lambda t: ops.coordinate_validity(t.locations),
    f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {VALID}) AS ok,
        count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS gone FROM locations)
    SELECT n AS row_count, ok AS valid_count, {pct('ok', 'n')} AS valid_pct, n - ok AS invalid_count,
        {pct('n - ok', 'n')} AS invalid_pct, gone AS null_count, {pct('gone', 'n')} AS null_pct FROM c""",
)
query(
    "valid_coordinates_flag",
    lambda t: ops.valid_coordinates_flag(t.locations),
    f"""SELECT count(*) FILTER (WHERE {VALID}) AS valid_count,
        round(count(*) FILTER (WHERE {VALID}) * 100.0 / count(*), 6) AS valid_pct,
        count(*) FILTER (WHERE {VALID}) * 100.0 / count(*) < 90 AS warning FROM locations""",
)
query(
    "name_quality",
    lambda t: ops.name_quality(t.locations),
    f"""WITH d AS (SELECT count(*) AS n, count(*) - count(name) AS gone,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT name FROM locations)) AS again FROM locations)
    SELECT n AS row_count, gone AS missing_count, {pct('gone', 'n')} AS missing_pct,
        again AS duplicate_count, {pct('again', 'n')} AS duplicate_pct FROM d""",
)
query(
    "category_distribution",
    lambda t: ops.category_distribution(t.locations, "main_category"),
    "SELECT main_category AS category, count(*) AS location_count FROM locations WHERE main_category IS NOT NULL GROUP BY 1",
)
query(
    "category_distribution_part",
    lambda t: ops.category_distribution(t.part, "p_type"),
    "SELECT p_type AS category, count(*) AS location_count FROM part GROUP BY 1",
    on_locations=False,
)


def _missing_and_sql(column: str, label: str, test: str) -> str:
    hit = f"count(*) FILTER (WHERE {test})"
    return f"""SELECT count(*) AS row_count, count(*) - count({column}) AS missing_count,
        {pct(f'count(*) - count({column})')} AS missing_pct, {hit} AS {label}_count, {pct(hit)} AS {label}_pct FROM locations"""


query("address_quality", lambda t: ops.address_quality(t.locations), _missing_and_sql("address", "incomplete", "length(address) < 10"))
query(
    "phone_quality",
    lambda t: ops.phone_quality(t.locations),
    _missing_and_sql("phone", "invalid", r"NOT regexp_matches(phone, '^\+?[0-9\-\(\)\s]{7,20}$')"),
)

# Text dates by the first format that reads half of the rows; the free reading needs a year in front.
TEMPORAL_TEXT = [c for c in NOT_NULL_TEXT if any(k in c for k in ("date", "time", "year", "month", "day"))]


def _text_date_sql(table: str, column: str) -> str:
    tries = [f"try_strptime({column}, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y")]
    tries.append(f"CASE WHEN regexp_matches({column}, '^[0-9]{{4}}-') THEN try_cast({column} AS TIMESTAMP) END")
    stats = ", ".join(f"count({x}) AS n{j}, min({x}) AS lo{j}, max({x}) AS hi{j}" for j, x in enumerate(tries))

    def pick(kind: str) -> str:
        return "CASE " + " ".join(f"WHEN (n - n{j}) / n <= 0.5 THEN {kind}{j}" for j in range(3)) + f" ELSE {kind}3 END"

    return f"""SELECT '{column}' AS "column", m AS missing_count, {pct('m', 'n')} AS missing_pct, {pick('n')} AS parsed_count,
        strftime({pick('lo')}, '%Y-%m-%d') AS min_date, strftime({pick('hi')}, '%Y-%m-%d') AS max_date,
        datesub('day', {pick('lo')}, {pick('hi')}) AS range_days, {pick('n')} = 0 AND m < n AS format_issues
        FROM (SELECT count(*) AS n, count(*) - count({column}) AS m, {stats} FROM {table})"""


def _real_date_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) - count({column}) AS missing_count,
        {pct(f'count(*) - count({column})')} AS missing_pct, count({column}) AS parsed_count,
        strftime(min({column}), '%Y-%m-%d') AS min_date, strftime(max({column}), '%Y-%m-%d') AS max_date,
        datesub('day', min({column}), max({column})) AS range_days, count({column}) = 0 AND count(*) > 0 AS format_issues FROM {table}"""


query("temporal_profile_orders", lambda t: ops.temporal_profile(t.orders), _real_date_sql("orders", "o_orderdate"), on_locations=False)
query("temporal_profile_events", lambda t: ops.temporal_profile(t.events, ["ts"]), _real_date_sql("events", "ts"), on_locations=False)
query(
    "temporal_profile",
    lambda t: ops.temporal_profile(t.locations),
    " UNION ALL ".join(_text_date_sql("locations", c) for c in TEMPORAL_TEXT),
)
query("temporal_profile_dates", lambda t: ops.temporal_profile(t.locations, ["opened_on"]), _real_date_sql("locations", "opened_on"))

# Missing shares of address, name and phone; the table has no column named like a category.
SCORE = f"""WITH m AS ({missing_sql('locations', LOCATION_COLUMNS)}),
    d AS (SELECT {pct('count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM locations))')} AS dup,
        {pct(f'count(*) - count(*) FILTER (WHERE {VALID})')} AS bad FROM locations),
    o AS (SELECT {pct('sum(missing_count)', 'sum(row_count)')} AS miss,
        sum(missing_pct) FILTER (WHERE "column" IN ('address', 'name', 'phone')) / 10.0 AS key_fields FROM m)"""
SCORE_VALUE = """round_even(greatest(0.0, least(100.0, 100.0 - (least(30.0, miss / 2) + least(20.0, dup * 2)
    + least(15.0, bad / 2) + least(25.0, key_fields)))), 1)"""
query(
    "quality_score",
    lambda t: ops.quality_score(t.locations),
    f"{SCORE} SELECT {SCORE_VALUE} AS quality_score, round_even(100.0 - miss, 1) AS completeness FROM o, d",
)
query(
    "analyze_scores_and_fields",
    lambda t: ops.analyze(t.locations).filter(
        "section IN ('scores', 'location_data', 'phone_numbers', 'duplicate_rows') AND metric NOT LIKE '%count'"
    ).select("section", "metric", "value"),
    f"""{SCORE} SELECT 'scores' AS section, 'quality_score' AS metric, {SCORE_VALUE} AS value FROM o, d
    UNION ALL SELECT 'scores', 'completeness', round_even(100.0 - miss, 1) FROM o
    UNION ALL SELECT 'scores', 'overall_missing_pct', miss FROM o
    UNION ALL SELECT 'duplicate_rows', 'duplicate_pct', dup FROM d
    UNION ALL SELECT 'location_data', 'invalid_pct', bad FROM d
    UNION ALL SELECT 'location_data', 'valid_pct', {pct(f'count(*) FILTER (WHERE {VALID})')} FROM locations
    UNION ALL SELECT 'location_data', 'null_pct', {pct('count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL)')} FROM locations
    UNION ALL SELECT 'phone_numbers', 'missing_pct', missing_pct FROM m WHERE "column" = 'phone'
    UNION ALL SELECT 'phone_numbers', 'invalid_pct',
        {pct(r"count(*) FILTER (WHERE NOT regexp_matches(phone, '^\+?[0-9\-\(\)\s]{7,20}$'))")} FROM locations""",
)


def _two(section: str, column: str, metric: str, count: str) -> str:
    """Count and percentage of one condition over the locations."""
    return f"""SELECT '{section}', '{column}', '{metric}_count', CAST({count} AS DOUBLE), NULL FROM locations
    UNION ALL SELECT '{section}', '{column}', '{metric}_pct', {pct(count)}, NULL FROM locations"""


def _gaps(section: str, table: str, columns) -> str:
    return f"""SELECT '{section}', "column", 'missing_count', CAST(missing_count AS DOUBLE), NULL FROM ({missing_sql(table, columns)})
    UNION ALL SELECT '{section}', "column", 'missing_pct', missing_pct, NULL FROM ({missing_sql(table, columns)})"""


def _copies(table: str) -> str:
    return f"""SELECT 'duplicate_rows', NULL, 'duplicate_count', CAST(duplicate_count AS DOUBLE), NULL FROM ({duplicates_sql(table)})
    UNION ALL SELECT 'duplicate_rows', NULL, 'duplicate_pct', duplicate_pct, NULL FROM ({duplicates_sql(table)})"""


def _types(table: str, types: dict[str, str]) -> str:
    return f"""SELECT 'basic' AS section, "column", 'column_type' AS metric, CAST(position AS DOUBLE) AS value, type AS text
    FROM ({basic_sql(table, types)})"""


def _dates(source: str) -> str:
    return f"""SELECT 'temporal_data', "column", unnest(['missing_count', 'missing_pct', 'range_days', 'min_date', 'max_date']),
        unnest([missing_count::DOUBLE, missing_pct, range_days::DOUBLE, NULL, NULL]), unnest([NULL, NULL, NULL, min_date, max_date])
        FROM ({source})"""


NAME_REPEATS = "count(*) - (SELECT count(*) FROM (SELECT DISTINCT name FROM locations))"
query(
    "analyze",
    lambda t: ops.analyze(t.locations),
    SCORE
    + " UNION ALL ".join(
        [
            _types("locations", LOCATION_TYPES),
            _gaps("missing_values", "locations", LOCATION_COLUMNS),
            _gaps("addresses", "locations", ["address"]),
            _gaps("business_names", "locations", ["name"]),
            _gaps("phone_numbers", "locations", ["phone"]),
            _copies("locations"),
            _two("location_data", "latitude", "valid", f"count(*) FILTER (WHERE {VALID})"),
            _two("location_data", "latitude", "invalid", f"count(*) - count(*) FILTER (WHERE {VALID})"),
            _two("location_data", "latitude", "null", "count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL)"),
            _two("addresses", "address", "incomplete", "count(*) FILTER (WHERE length(address) < 10)"),
            _two("phone_numbers", "phone", "invalid", r"count(*) FILTER (WHERE NOT regexp_matches(phone, '^\+?[0-9\-\(\)\s]{7,20}$'))"),
            _two("business_names", "name", "duplicate", NAME_REPEATS),
            f"SELECT 'scores', NULL, 'quality_score', {SCORE_VALUE}, NULL FROM o, d",
            "SELECT 'scores', NULL, 'completeness', round_even(100.0 - miss, 1), NULL FROM o",
            "SELECT 'scores', NULL, 'overall_missing_pct', miss, NULL FROM o",
            _dates(" UNION ALL ".join(_text_date_sql("locations", c) for c in TEMPORAL_TEXT)),
        ]
    ),
)
# No column of lineitem plays the part of an address, name, phone or coordinate.
query(
    "analyze_lineitem",
    lambda t: ops.analyze(t.lineitem),
    f"""WITH g AS (SELECT {pct('sum(missing_count)', 'sum(row_count)')} AS miss FROM ({missing_sql('lineitem', LINEITEM_COLUMNS)})),
    c AS ({duplicates_sql('lineitem')})
    """
    + " UNION ALL ".join(
        [
            _types("lineitem", LINEITEM_TYPES),
            _gaps("missing_values", "lineitem", LINEITEM_COLUMNS),
            _copies("lineitem"),
            """SELECT 'scores', NULL, 'quality_score',
                round_even(greatest(0.0, 100.0 - (least(30.0, miss / 2) + least(20.0, duplicate_pct * 2))), 1), NULL FROM g, c""",
            "SELECT 'scores', NULL, 'completeness', round_even(100.0 - miss, 1), NULL FROM g",
            "SELECT 'scores', NULL, 'overall_missing_pct', miss, NULL FROM g",
            _dates(_real_date_sql("lineitem", "l_shipdate")),
        ]
    ),
    on_locations=False,
)


def _leading_sql(table: str, types: dict[str, str], order: str, count: int) -> dict[str, str]:
    return {
        c: f"(SELECT string_agg(v, ', ' ORDER BY k) FROM (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {order}) AS k"
        f" FROM {table} WHERE {c} IS NOT NULL ORDER BY k LIMIT {count}))"
        for c in types
    }


TEXT_OVERVIEW = ["location_id", "name", "chain_id", "city", "phone", "email", "opened_on", "monday_open"]
query(
    "column_overview",
    lambda t: ops.column_overview(t.locations.select(*TEXT_OVERVIEW), ["location_id"]),
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS position, '{LOCATION_TYPES[c]}' AS type, {pct(f'count(*) - count({c})')} AS missing_pct,
            {_leading_sql('locations', {c: ''}, 'location_id', 3)[c]} AS sample_values FROM locations"""
        for i, c in enumerate(TEXT_OVERVIEW)
    ),
)
DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
query(
    "column_overview_documents",
    lambda t: ops.column_overview(t.documents, ["doc_id"]),
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS position, '{k}' AS type, {pct(f'count(*) - count({c})')} AS missing_pct,
            {_leading_sql('documents', {c: ''}, 'doc_id', 3)[c]} AS sample_values FROM documents"""
        for i, (c, k) in enumerate(DOCUMENT_TYPES.items())
    ),
    on_locations=False,
)
query(
    "validation_summary",
    lambda t: ops.validation_summary(t.locations),
    f"""WITH m AS ({missing_sql('locations', LOCATION_COLUMNS)}), d AS ({duplicates_sql('locations')}),
    s AS (SELECT max(row_count) AS rows, count(*) AS column_count, {pct('sum(missing_count)', 'sum(row_count)')} AS null_percentage,
        count(*) FILTER (WHERE missing_pct > 5) AS problem_columns FROM m)
    SELECT row_count, column_count, null_percentage, problem_columns, duplicate_count, duplicate_pct,
        problem_columns || ' columns above 5% missing; ' || duplicate_count || ' duplicate rows' AS potential_issues FROM s, d""",
)
query(
    "problem_columns",
    lambda t: ops.problem_columns(t.locations),
    f"""WITH m AS ({missing_sql('locations', LOCATION_COLUMNS)}) SELECT "column", missing_pct FROM m WHERE missing_pct > 5""",
)
query(
    "missing_report",
    lambda t: ops.missing_report(t.locations),
    f"""WITH m AS ({missing_sql('locations', LOCATION_COLUMNS)})
    SELECT "column", missing_count, missing_pct, missing_pct > 20 AS critical FROM m WHERE missing_count > 0""",
)
query(
    "validate_table",
    lambda t: ops.validate_table(t.locations),
    """SELECT 2 AS check_no, 'Missing required columns: id' AS issue FROM locations HAVING count(*) > 0""",
)


def _size_sql(table: str, types: dict[str, str]) -> str:
    sizes = "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS position, """
        + (f"count({c}) * {WIDTHS[k]}" if k in WIDTHS else f"CAST(coalesce(sum(strlen({c})), 0) AS BIGINT)")
        + f" AS bytes FROM {table}"
        for i, (c, k) in enumerate(types.items())
    )
    return f"""WITH s AS ({sizes}) SELECT "column", position, bytes, round(bytes * 100.0 / sum(bytes) OVER (), 6) AS percent FROM s"""


query("size_profile", lambda t: ops.size_profile(t.locations), _size_sql("locations", LOCATION_TYPES))
query("size_profile_documents", lambda t: ops.size_profile(t.documents), _size_sql("documents", DOCUMENT_TYPES), on_locations=False)


def keys_sql(table: str, columns) -> str:
    return union_per_column(
        columns,
        f"""SELECT '{{c}}' AS "column", count(DISTINCT {{c}}) AS distinct_count FROM {table}
            HAVING count(DISTINCT {{c}}) = count(*) AND count({{c}}) = count(*)""",
    )


CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
query("key_candidates", lambda t: ops.key_candidates(t.locations), keys_sql("locations", LOCATION_COLUMNS))
query(
    "distinct_row_keys",
    lambda t: ops.distinct_row_keys(t.locations),
    keys_sql("(SELECT DISTINCT * FROM locations)", LOCATION_COLUMNS),
)
query("key_candidates_customer", lambda t: ops.key_candidates(t.customer), keys_sql("customer", CUSTOMER_COLUMNS), on_locations=False)

MIXED_COLUMNS = NOT_NULL_TEXT


def _class_sql(label: str, c: str) -> str:
    return f"count(*) FILTER (WHERE regexp_matches({c}, '{ops.VALUE_CLASSES[label]}'))"


query(
    "mixed_types",
    lambda t: ops.mixed_types(t.locations),
    "WITH c AS ("
    + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {LOCATION_COLUMNS.index(c)} AS position, {_class_sql('number', c)} AS number_count,
        {_class_sql('date', c)} AS date_count, {_class_sql('boolean', c)} AS boolean_count,
        count(*) FILTER (WHERE {c} <> '') AS filled FROM locations"""
        for c in MIXED_COLUMNS
    )
    + """), t AS (SELECT *, filled - number_count - date_count - boolean_count AS text_count FROM c)
    SELECT "column", position, number_count, date_count, boolean_count, text_count,
        concat_ws(', ', CASE WHEN number_count > 0 THEN 'number' END, CASE WHEN date_count > 0 THEN 'date' END,
            CASE WHEN boolean_count > 0 THEN 'boolean' END, CASE WHEN text_count > 0 THEN 'text' END) AS classes,
        (number_count > 0)::INT + (date_count > 0)::INT + (boolean_count > 0)::INT + (text_count > 0)::INT > 1 AS mixed FROM t""",
)

# Type inference: one branch per column.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://(?:[-\w.]|(?:%[0-9a-fA-F]{2}))+"
PHONE = r"^\+?[0-9\s\(\)-]{7,20}$"
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"
KIND_NAMES = {"bigint": "numeric", "int": "numeric", "double": "numeric", "date": "datetime", "timestamp_ntz": "datetime"}


def _type_sql(table: str, types: dict[str, str], order: str, samples: bool = True) -> str:
    rows = []
    for i, (c, k) in enumerate(types.items()):
        number = KIND_NAMES.get(k) == "numeric"
        categories = f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY v LIMIT 10))"
        few = f"count(DISTINCT {c}) < 20 AND count(DISTINCT {c}) / count({c}) < 0.1"
        kind = (
            f"CASE WHEN count({c}) = 0 THEN 'empty' ELSE '{KIND_NAMES[k]}' END"
            if k in KIND_NAMES
            else f"""CASE WHEN count({c}) = 0 THEN 'empty' WHEN {few} THEN 'categorical'
                WHEN bool_and(regexp_matches({c}, '{URL}')) THEN 'url' WHEN bool_and(regexp_matches({c}, '{EMAIL}')) THEN 'email'
                WHEN bool_and(regexp_matches({c}, '{PHONE}')) THEN 'phone_number'
                WHEN bool_or(regexp_matches({c}, '{DATE}')) THEN 'date_string' ELSE 'text' END"""
        )
        rows.append(
            f"""SELECT '{c}' AS "column", {i} AS position, '{k}' AS engine_type, {kind} AS inferred_type,
            count({c}) < count(*) AS contains_nulls,
            {f'CAST(min({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS min_value,
            {f'CAST(max({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS max_value,
            {f'round(avg({c}), 6)' if number else 'CAST(NULL AS DOUBLE)'} AS mean_value,
            {f"CASE WHEN {few} THEN {categories} END" if k == 'string' else 'NULL::VARCHAR'} AS categories,
            {f"CASE WHEN {few} THEN count(DISTINCT {c}) END" if k == 'string' else 'NULL::BIGINT'} AS category_count
            {"," + _leading_sql(table, {c: ''}, order, 5)[c] + " AS sample_values" if samples else ""} FROM {table}"""
        )
    return "\nUNION ALL ".join(rows)


def _rounded(df):
    return df.selectExpr(*[f"round({c}, 6) AS {c}" if c == "mean_value" else f"`{c}`" for c in df.columns])


query(
    "detect_types",
    lambda t: _rounded(detect_types(t.locations, ["location_id"]).drop("sample_values")),
    _type_sql("locations", LOCATION_TYPES, "location_id", samples=False),
)
query(
    "detect_types_customer",
    lambda t: _rounded(detect_types(t.customer, ["c_custkey"]).drop("sample_values")),
    _type_sql(
        "customer",
        {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
        "c_custkey",
        samples=False,
    ),
    on_locations=False,
)
query(
    "detect_types_events",
    lambda t: _rounded(detect_types(t.events.select("event_id", "user_id", "event_type", "props"), ["event_id"])),
    _type_sql("events", {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "props": "string"}, "event_id"),
    on_locations=False,
)
