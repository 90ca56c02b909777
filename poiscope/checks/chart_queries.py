"""Data behind the charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from poiscope.checks.columns import LOCATION_COLUMNS, LOCATION_TYPES
from poiscope.checks.dimension_queries import FIELD_SQL, _share
from poiscope.checks.location_queries import OPEN, RETAIL, SCORE
from poiscope.checks.profile_queries import missing_sql
from poiscope.checks.registry import query
from poiscope.operators import chartdata as ops, dimension_quality, locations, profile

query(
    "top_categories",
    lambda t: ops.top_categories(profile.category_distribution(t.locations, "sub_category")),
    """SELECT sub_category AS category, count(*) AS location_count FROM locations WHERE sub_category IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
query(
    "top_segments",
    lambda t: ops.top_categories(locations.retail_segments(t.locations), n=8).select("category", "location_count"),
    f"""SELECT sub_category AS category, count(*) AS location_count FROM locations WHERE sub_category <> '' AND {OPEN} AND {RETAIL}
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""",
)
for _n in (10, 20):
    query(
        f"missing_top_{_n}",
        lambda t, n=_n: ops.missing_top(t.locations, n),
        f"""SELECT "column", missing_pct FROM ({missing_sql('locations', LOCATION_COLUMNS)}) ORDER BY missing_pct DESC, "column" LIMIT {_n}""",
    )
NUMBERS = [c for c, k in LOCATION_TYPES.items() if k in ("double", "bigint")]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(table: str, columns) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM {table}" for a, b in combinations(columns, 2)
    )


def _rounded(df):
    return df.withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


query("correlation_matrix", lambda t: _rounded(ops.correlation_matrix(t.locations)), _corr_sql("locations", NUMBERS))
query(
    "correlation_matrix_lineitem",
    lambda t: _rounded(ops.correlation_matrix(t.lineitem, LINE_NUMBERS)),
    _corr_sql("lineitem", LINE_NUMBERS),
    on_locations=False,
)


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""SELECT bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS upper, count(*) AS rows
        FROM (SELECT lo, hi, least(CAST(floor(({column} - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin
            FROM {source}, (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {source}) WHERE {column} IS NOT NULL)
        GROUP BY bin, lo, hi"""


def _round_edges(df):
    return df.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "rows")


query("histogram_price", lambda t: _round_edges(ops.histogram(t.locations, "price_amount")), _histogram_sql("locations", "price_amount", 30))
query(
    "histogram_quantity",
    lambda t: _round_edges(ops.histogram(t.lineitem, "l_quantity", 12)),
    _histogram_sql("lineitem", "l_quantity", 12),
    on_locations=False,
)
WINDOW_HOURS = f"""(SELECT coalesce(CAST(substr(monday_close, 1, 2) AS INTEGER) - CAST(substr(monday_open, 1, 2) AS INTEGER), 8) AS window_hours
    FROM locations WHERE {OPEN} AND {RETAIL})"""
query(
    "histogram_window_hours",
    lambda t: _round_edges(ops.histogram(locations.delivery_windows(t.locations), "window_hours", 12)),
    _histogram_sql(WINDOW_HOURS, "window_hours", 12),
)
query(
    "column_scores_sorted",
    lambda t: ops.column_scores_sorted(t.locations),
    f"""SELECT "column", 100.0 - missing_pct AS score FROM ({missing_sql('locations', LOCATION_COLUMNS)})
        ORDER BY score DESC, "column" DESC LIMIT 10""",
)
FIELDS = ["missing_address_pct", "missing_hours_pct", "low_confidence_pct"]
TESTS = {"missing_address_pct": "address IS NULL", "missing_hours_pct": "monday_open IS NULL", "low_confidence_pct": f"{SCORE} < 0.7"}
query(
    "missing_by_category",
    lambda t: ops.missing_by_group(dimension_quality.distribution_quality(t.locations), "main_category", FIELDS),
    "\nUNION ALL ".join(
        f"""SELECT main_category, '{f}' AS field, {_share(test)} AS missing_pct FROM locations WHERE {OPEN} AND {RETAIL} GROUP BY main_category"""
        for f, test in TESTS.items()
    ),
)
query(
    "missing_matrix_by_category",
    lambda t: ops.missing_matrix(dimension_quality.distribution_quality(t.locations), "main_category", FIELDS),
    "\nUNION ALL ".join(
        f"""SELECT '{f}' AS field, {_share(test).replace("(WHERE", "(WHERE main_category = 'retail' AND").replace("/ count(*)", "/ count(*) FILTER (WHERE main_category = 'retail')")} AS retail,
        {_share(test).replace("(WHERE", "(WHERE main_category = 'convenience_and_grocery_stores' AND").replace("/ count(*)", "/ count(*) FILTER (WHERE main_category = 'convenience_and_grocery_stores')")}
        AS convenience_and_grocery_stores FROM locations WHERE {OPEN} AND {RETAIL}"""
        for f, test in TESTS.items()
    ),
)
query(
    "missing_by_field_group",
    lambda t: dimension_quality.field_group_completeness(t.locations).select("data_category", "field", "missing_pct"),
    f"SELECT data_category, field, missing_pct FROM ({FIELD_SQL})",
)
