"""Business queries (location analytics)."""

from __future__ import annotations

from poiscope.checks.registry import query
from poiscope.operators import locations as ops

RETAIL = "main_category IN ('retail', 'convenience_and_grocery_stores')"
OPEN = "open_closed_status = 'open'"
CHAIN = "chain_id <> '' AND chain_id IS NOT NULL"
SCORE = "data_quality_confidence_score"

POINT_COLUMNS = f"""location_id, name, chain_name, main_category, sub_category, address, city, state, postal_code,
    latitude, longitude, open_closed_status, {SCORE}"""

query(
    "active_distribution_points",
    lambda t: ops.active_distribution_points(t.locations),
    f"SELECT {POINT_COLUMNS} FROM locations WHERE {OPEN} AND {RETAIL} AND address IS NOT NULL AND {SCORE} >= 0.0",
)
query(
    "active_distribution_points_city",
    lambda t: ops.active_distribution_points(t.locations, min_confidence=0.5, city="City 1"),
    f"""SELECT {POINT_COLUMNS} FROM locations
        WHERE city = 'City 1' AND {OPEN} AND {RETAIL} AND address IS NOT NULL AND {SCORE} >= 0.5""",
)


def _window_sql(day: str) -> str:
    hour = lambda c: f"CAST(substr({c}, 1, 2) AS INTEGER)"
    return f"""SELECT location_id, name, address, city, main_category, sub_category,
        coalesce({day}_open, '09:00:00') AS {day}_open,
        coalesce({day}_close, '17:00:00') AS {day}_close,
        coalesce({hour(day + '_close')} - {hour(day + '_open')}, 8) AS window_hours
        FROM locations WHERE {RETAIL} AND {OPEN}"""


for _day in ("monday", "saturday"):
    query(f"delivery_windows_{_day}", lambda t, d=_day: ops.delivery_windows(t.locations, d), _window_sql(_day))

query(
    "delivery_windows_strict",
    lambda t: ops.delivery_windows_strict(t.locations, "Tuesday"),
    """SELECT location_id, name, CAST(split_part(tuesday_open, ':', 1) AS INTEGER) AS open_hour,
        CAST(split_part(tuesday_close, ':', 1) AS INTEGER) AS close_hour,
        CAST(split_part(tuesday_close, ':', 1) AS INTEGER) - CAST(split_part(tuesday_open, ':', 1) AS INTEGER) AS window_hours
        FROM locations WHERE tuesday_open IS NOT NULL AND tuesday_close IS NOT NULL""",
)
query(
    "chain_store_targets",
    lambda t: ops.chain_store_targets(t.locations),
    f"""SELECT chain_name, count(*) AS location_count, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities,
        min({SCORE}) AS min_confidence, max({SCORE}) AS max_confidence, avg({SCORE}) AS avg_confidence
        FROM locations WHERE {CHAIN} AND {OPEN} AND {RETAIL} GROUP BY chain_name HAVING count(*) >= 2""",
)

COVERAGE = f"""SELECT city, state, count(*) AS n, count(DISTINCT sub_category) AS subs FROM locations
    WHERE city IS NOT NULL AND state IS NOT NULL AND {OPEN} AND {RETAIL} GROUP BY city, state"""

query(
    "distribution_gaps",
    lambda t: ops.distribution_gaps(t.locations),
    f"SELECT city, state, n AS location_count, subs AS category_count FROM ({COVERAGE}) WHERE n < 20",
)
query(
    "territory_coverage",
    lambda t: ops.territory_coverage(t.locations),
    f"""SELECT city, state, n AS location_count, subs AS category_diversity,
        round(CAST(subs AS DOUBLE) / n, 2) AS diversity_ratio FROM ({COVERAGE})""",
)
query(
    "retail_segments",
    lambda t: ops.retail_segments(t.locations),
    f"""SELECT sub_category AS category, count(*) AS location_count,
        round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
        FROM locations WHERE sub_category <> '' AND {OPEN} AND {RETAIL} GROUP BY sub_category""",
)
DENSITY = f"""SELECT postal_code, city, count(*) AS total_locations,
    count(*) FILTER (WHERE main_category = 'retail') AS retail_locations,
    count(*) FILTER (WHERE main_category <> 'retail') AS grocery_locations,
    count(*) FILTER (WHERE {CHAIN}) AS chain_locations,
    string_agg(DISTINCT sub_category, ', ' ORDER BY sub_category) AS retail_types
    FROM locations WHERE postal_code IS NOT NULL AND {OPEN} AND {RETAIL} GROUP BY postal_code, city
    ORDER BY total_locations DESC, postal_code, city NULLS LAST"""
query("competitive_density", lambda t: ops.competitive_density(t.locations), DENSITY + " LIMIT 10")
query("competitive_density_top_25", lambda t: ops.competitive_density(t.locations, top_n=25), DENSITY + " LIMIT 25")
query(
    "customer_engagement",
    lambda t: ops.customer_engagement(t.locations),
    f"""SELECT main_category, sub_category, count(*) AS location_count,
        round(avg(CAST(popularity_score AS FLOAT)), 1) AS avg_popularity,
        round(avg(CAST(sentiment_score AS FLOAT)), 2) AS avg_sentiment,
        round(avg(CAST(dwell_time AS FLOAT)), 1) AS avg_dwell_minutes
        FROM locations WHERE {OPEN} AND ({RETAIL} OR main_category = 'dining')
        GROUP BY main_category, sub_category HAVING count(*) > 5""",
)
query(
    "geographic_clusters",
    lambda t: ops.geographic_clusters(t.locations),
    f"""SELECT postal_code, round(latitude, 2) AS latitude_area, round(longitude, 2) AS longitude_area,
        count(*) AS locations_in_cluster,
        string_agg(DISTINCT main_category, ', ' ORDER BY main_category) AS business_types,
        string_agg(DISTINCT chain_name, ', ' ORDER BY chain_name) AS chains_in_area
        FROM locations WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND {OPEN} AND {RETAIL}
        GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
)
query(
    "critical_completeness",
    lambda t: ops.critical_completeness(t.locations),
    f"""SELECT count(*) AS total_records,
        count(*) FILTER (WHERE coalesce(address, '') = '') AS missing_address,
        count(*) FILTER (WHERE coalesce(monday_open, '') = '' OR coalesce(monday_close, '') = '') AS missing_hours,
        count(*) FILTER (WHERE coalesce(website, '') = '') AS missing_website,
        count(*) FILTER (WHERE {SCORE} < 0.7) AS low_confidence
        FROM locations WHERE {OPEN} AND {RETAIL}""",
)
CHAIN_QUALITY = f"""SELECT chain_name, count(*) AS total_locations, count(*) - count(address) AS missing_address,
    count(*) FILTER (WHERE monday_open IS NULL OR monday_close IS NULL) AS missing_hours,
    count(*) - count(website) AS missing_website, round(avg({SCORE}), 2) AS avg_confidence_score
    FROM locations WHERE {CHAIN} AND {OPEN} AND {RETAIL} GROUP BY chain_name HAVING count(*) > 3"""
query("chain_data_quality", lambda t: ops.chain_data_quality(t.locations), CHAIN_QUALITY)
query(
    "chain_spread",
    lambda t: ops.chain_spread(t.locations),
    f"""SELECT name AS chain_name, count(*) AS location_count, count(DISTINCT postal_code) AS postal_codes_covered,
        count(DISTINCT city) AS cities_covered, round(avg({SCORE}), 2) AS avg_confidence
        FROM locations GROUP BY name HAVING count(*) >= 3""",
)
query(
    "top_chain_targets",
    lambda t: ops.top_rows(ops.chain_store_targets(t.locations), "location_count", 10, "chain_name"),
    f"""SELECT chain_name, count(*) AS location_count, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities,
        min({SCORE}) AS min_confidence, max({SCORE}) AS max_confidence, avg({SCORE}) AS avg_confidence
        FROM locations WHERE {CHAIN} AND {OPEN} AND {RETAIL} GROUP BY chain_name HAVING count(*) >= 2
        ORDER BY location_count DESC, chain_name NULLS LAST LIMIT 10""",
)
query(
    "top_territories",
    lambda t: ops.top_rows(ops.territory_coverage(t.locations), "location_count", 10, "city", "state"),
    f"""SELECT city, state, n AS location_count, subs AS category_diversity,
        round(CAST(subs AS DOUBLE) / n, 2) AS diversity_ratio FROM ({COVERAGE})
        ORDER BY n DESC, city, state LIMIT 10""",
)


def _run_all_counts(t):
    """Row count of every analysis of the combined run."""
    from pyspark.sql import functions as F

    from poiscope.plans.longform import union_all

    results = ops.run_all(t.locations)
    return union_all([r.agg(F.count(F.lit(1)).alias("result_rows")).withColumn("analysis", F.lit(n)) for n, r in results.items()])


query(
    "run_all_analyses",
    _run_all_counts,
    f"""WITH kept AS (SELECT * FROM locations WHERE {OPEN} AND {RETAIL}), coverage AS ({COVERAGE})
    SELECT count(*) AS result_rows, 'distribution_points' AS analysis FROM kept WHERE address IS NOT NULL AND {SCORE} >= 0
    UNION ALL SELECT count(*), 'delivery_windows' FROM kept
    UNION ALL SELECT count(*), 'chain_targets' FROM (SELECT chain_name FROM kept WHERE {CHAIN} GROUP BY 1 HAVING count(*) >= 2)
    UNION ALL SELECT count(*), 'distribution_gaps' FROM coverage WHERE n < 20
    UNION ALL SELECT count(DISTINCT sub_category), 'retail_segments' FROM kept WHERE sub_category <> ''
    UNION ALL SELECT count(*), 'competitive_density' FROM (SELECT DISTINCT postal_code, city FROM kept WHERE postal_code IS NOT NULL LIMIT 10)
    UNION ALL SELECT count(*), 'customer_engagement' FROM (SELECT 1 FROM locations WHERE {OPEN}
        AND ({RETAIL} OR main_category = 'dining') GROUP BY main_category, sub_category HAVING count(*) > 5)
    UNION ALL SELECT count(*), 'territory_coverage' FROM coverage
    UNION ALL SELECT count(*), 'geographic_clusters' FROM (SELECT 1 FROM kept WHERE latitude IS NOT NULL AND longitude IS NOT NULL
        GROUP BY postal_code, round(latitude, 2), round(longitude, 2) HAVING count(*) >= 3)
    UNION ALL SELECT 1, 'data_completeness'
    UNION ALL SELECT count(*), 'chain_data_quality' FROM ({CHAIN_QUALITY})""",
)
