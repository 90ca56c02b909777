"""Cleaning steps, change logs and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from poiscope.checks.columns import LOCATION_COLUMNS
from poiscope.checks.profile_queries import missing_sql
from poiscope.checks.registry import query
from poiscope.operators import cleaning as ops
from poiscope.operators.cleaning import ConvertType, FillMissing, HandleOutliers, RemoveDuplicates, StandardizeValues

ID = ["location_id"]


def _cleaned(t, *steps):
    return ops.clean(t.locations, steps).frame


def _filled(step, *columns):
    return lambda t: _cleaned(t, step).selectExpr("location_id", *columns)


query(
    "fill_constant",
    lambda t: _cleaned(t, FillMissing("address", "Unknown")),
    "SELECT * REPLACE (coalesce(address, 'Unknown') AS address) FROM locations",
)
query(
    "fill_mean",
    lambda t: _cleaned(t, FillMissing("popularity_score", method="mean")).select(
        "location_id", F.round("popularity_score", 6).alias("popularity_score")
    ),
    """SELECT location_id, round(coalesce(popularity_score, (SELECT avg(popularity_score) FROM locations)), 6) AS popularity_score
        FROM locations""",
)
query(
    "fill_median",
    _filled(FillMissing("sentiment_score", method="median"), "sentiment_score"),
    """SELECT location_id, coalesce(sentiment_score, (SELECT quantile_cont(sentiment_score, 0.5) FROM locations)) AS sentiment_score
        FROM locations""",
)
query(
    "fill_mode",
    _filled(FillMissing("city", method="mode"), "city"),
    """SELECT location_id, coalesce(city, (SELECT city FROM locations WHERE city IS NOT NULL GROUP BY city
        ORDER BY count(*) DESC, city LIMIT 1)) AS city FROM locations""",
)
query(
    "fill_forward",
    lambda t: _cleaned(t, FillMissing("phone", method="forward_fill", order_by=ID)),
    """SELECT * REPLACE (last_value(phone IGNORE NULLS) OVER (ORDER BY location_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phone) FROM locations""",
)
query(
    "fill_backward",
    lambda t: _cleaned(t, FillMissing("phone", method="backward_fill", order_by=ID)),
    """SELECT * REPLACE (last_value(phone IGNORE NULLS) OVER (ORDER BY location_id DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phone) FROM locations""",
)
query(
    "fill_forward_by_state",
    lambda t: _cleaned(t, FillMissing("chain_name", method="forward_fill", order_by=ID, partition_by=["state"])),
    """SELECT * REPLACE (last_value(chain_name IGNORE NULLS) OVER (PARTITION BY state ORDER BY location_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain_name) FROM locations""",
)
query(
    "fill_backward_orders",
    lambda t: ops.clean(
        t.orders.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))),
        [FillMissing("o_totalprice", method="backward_fill", order_by=["o_orderdate", "o_orderkey"], partition_by=["o_orderpriority"])],
    ).frame,
    """SELECT * REPLACE (last_value(CASE WHEN o_totalprice > 200000 THEN o_totalprice END IGNORE NULLS) OVER (
        PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_totalprice) FROM orders""",
    on_locations=False,
)
query("remove_duplicates", lambda t: _cleaned(t, RemoveDuplicates()), "SELECT DISTINCT * FROM locations")
query(
    "remove_duplicates_embeddings",
    lambda t: ops.clean(t.embeddings.select("label", "embedding"), [RemoveDuplicates()]).frame.groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "SELECT label, count(*) AS n FROM (SELECT DISTINCT label, embedding FROM embeddings) GROUP BY label",
    on_locations=False,
)
for _keep, _direction in (("first", ""), ("last", "DESC")):
    query(
        f"remove_duplicates_keep_{_keep}",
        lambda t, k=_keep: _cleaned(t, RemoveDuplicates(["name", "city"], k, ID)),
        f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY name, city ORDER BY location_id {_direction}) AS place
            FROM locations) WHERE place = 1""",
    )
query(
    "convert_to_date",
    _filled(ConvertType("opened_date_text", "date"), "CAST(opened_date_text AS DATE) AS opened_date_text"),
    "SELECT location_id, try_cast(opened_date_text AS DATE) AS opened_date_text FROM locations",
)
query(
    "convert_to_numeric",
    _filled(ConvertType("postal_code", "numeric"), "postal_code"),
    "SELECT location_id, try_cast(postal_code AS DOUBLE) AS postal_code FROM locations",
)
query(
    "convert_to_categorical",
    lambda t: _cleaned(t, ConvertType("sub_category", "categorical")),
    """SELECT *, CASE WHEN sub_category IS NOT NULL
        THEN dense_rank() OVER (ORDER BY sub_category NULLS LAST) - 1 END AS sub_category_code FROM locations""",
)
FENCES = """f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
    (SELECT quantile_cont(price_amount, 0.25) AS q1, quantile_cont(price_amount, 0.75) AS q3 FROM locations))"""
query(
    "cap_outliers",
    lambda t: _cleaned(t, HandleOutliers("price_amount")).withColumn("price_amount", F.round("price_amount", 6)),
    f"""WITH {FENCES} SELECT locations.* REPLACE (round(CASE WHEN price_amount < lo THEN lo WHEN price_amount > hi THEN hi
        ELSE price_amount END, 6) AS price_amount) FROM locations, f""",
)
query(
    "remove_outliers",
    lambda t: _cleaned(t, HandleOutliers("price_amount", "remove")),
    f"WITH {FENCES} SELECT locations.* FROM locations, f WHERE price_amount IS NULL OR price_amount BETWEEN lo AND hi",
)
query(
    "standardize_values",
    _filled(StandardizeValues("main_category", {"retail": "shops", "dining": "food"}), "main_category"),
    """SELECT location_id, CASE main_category WHEN 'retail' THEN 'shops' WHEN 'dining' THEN 'food' ELSE main_category END AS main_category
        FROM locations""",
)
query(
    "standardize_values_by_join",
    _filled(StandardizeValues("store_number_text", {str(i): f"store {i}" for i in range(0, 1000, 2)}), "store_number_text"),
    """SELECT location_id, CASE WHEN CAST(store_number_text AS BIGINT) % 2 = 0 THEN 'store ' || store_number_text
        ELSE store_number_text END AS store_number_text FROM locations""",
)
query(
    "standardize_values_numbers",
    lambda t: ops.clean(t.part, [StandardizeValues("p_size", {1: 1.5, 2: 2.25}), StandardizeValues("p_partkey", {i: -i for i in range(0, 5000, 3)})]).frame,
    """SELECT * REPLACE (
        CAST(CASE p_size WHEN 1 THEN 1.5 WHEN 2 THEN 2.25 ELSE p_size END AS DOUBLE) AS p_size,
        CASE WHEN p_partkey % 3 = 0 AND p_partkey < 5000 THEN -p_partkey ELSE p_partkey END AS p_partkey) FROM part""",
    on_locations=False,
)
query(
    "standardize_values_types",
    lambda t: ops.clean(
        t.part,
        [
            StandardizeValues("p_size", {1: "one", 2: "two", "three": "unreadable"}),
            StandardizeValues("p_partkey", {1: 1.5, 2: 7}),
            StandardizeValues("p_brand", {"Brand#11": None, "Brand#12": None}),
        ],
    ).frame,
    """SELECT * REPLACE (
        CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CAST(p_size AS VARCHAR) END AS p_size,
        CAST(CASE p_partkey WHEN 1 THEN 1.5 WHEN 2 THEN 7 ELSE p_partkey END AS DOUBLE) AS p_partkey,
        CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12') THEN p_brand END AS p_brand) FROM part""",
    on_locations=False,
)
query(
    "change_log_params",
    lambda t: ops.clean(t.part, [StandardizeValues("p_partkey", {i: -i for i in range(3, 900, 3)}), StandardizeValues("p_brand", {"a": "b"})])
    .change_log()
    .select("step_no", "column", "params", "rows_affected"),
    """SELECT 1 AS step_no, 'p_partkey' AS "column", '{"mapping": {' || (SELECT string_agg('"' || k || '": -' || k, ', ' ORDER BY k)
            FROM (SELECT CAST(i AS VARCHAR) AS k FROM range(3, 900, 3) r(i))) || '}}' AS params,
        (SELECT count(*) FROM part WHERE p_partkey % 3 = 0 AND p_partkey BETWEEN 3 AND 899) AS rows_affected
    UNION ALL SELECT 2, 'p_brand', '{"mapping": {"a": "b"}}', 0""",
    on_locations=False,
)
query(
    "standardize_column_names",
    lambda t: ops.standardize_column_names(t.part.select(
        F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("part__key"), F.col("p_size").alias(" P!!Size? ")
    )),
    "SELECT p_partkey AS part_key, p_name AS part_key_2, p_size AS p_size FROM part",
    on_locations=False,
)
query(
    "basic_clean",
    lambda t: ops.basic_clean(t.locations).frame,
    "SELECT DISTINCT * REPLACE (coalesce(address, 'Unknown') AS address) FROM locations",
)


def _log(t, *steps):
    return ops.clean(t.locations, steps).change_log().select("step_no", "step", "column", "rows_affected", "newly_null")


query(
    "basic_clean_log",
    lambda t: ops.basic_clean(t.locations).change_log().select("step_no", "step", "column", "rows_affected"),
    """SELECT 1 AS step_no, 'Fill Missing Values' AS step, 'address' AS "column", count(*) - count(address) AS rows_affected FROM locations
    UNION ALL SELECT 2, 'Remove Duplicates', NULL, count(*) - (SELECT count(*) FROM (SELECT DISTINCT
        * REPLACE (coalesce(address, 'Unknown') AS address) FROM locations)) FROM locations""",
)
query(
    "change_log",
    lambda t: _log(
        t,
        FillMissing("phone", method="forward_fill", order_by=ID),
        ConvertType("opened_date_text", "date"),
        HandleOutliers("price_amount"),
        RemoveDuplicates(["name", "city"], "first", ID),
        StandardizeValues("main_category", {"retail": "shops", "dining": "food"}),
    ),
    f"""WITH {FENCES},
    p AS (SELECT phone, last_value(phone IGNORE NULLS) OVER (ORDER BY location_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM locations),
    k AS (SELECT * FROM (SELECT main_category, row_number() OVER (PARTITION BY name, city ORDER BY location_id) AS place FROM locations) WHERE place = 1)
    SELECT 1 AS step_no, 'Fill Missing Values' AS step, 'phone' AS "column", count(*) AS rows_affected, NULL::BIGINT AS newly_null
        FROM p WHERE phone IS NULL AND filled IS NOT NULL
    UNION ALL SELECT 2, 'Convert Data Type', 'opened_date_text', count(*), count(opened_date_text) - count(try_cast(opened_date_text AS DATE)) FROM locations
    UNION ALL SELECT 3, 'Cap Outliers', 'price_amount', count(*) FILTER (WHERE price_amount < lo OR price_amount > hi), NULL FROM locations, f
    UNION ALL SELECT 4, 'Remove Duplicates', NULL, (SELECT count(*) FROM locations) - (SELECT count(*) FROM k), NULL
    UNION ALL SELECT 5, 'Standardize Values', 'main_category', count(*) FILTER (WHERE main_category IN ('retail', 'dining')), NULL FROM k""",
)

AFTER = "(SELECT DISTINCT * REPLACE (coalesce(address, 'Unknown') AS address) FROM locations)"
query(
    "before_after",
    lambda t: ops.before_after(t.locations, ops.basic_clean(t.locations).frame)
    .filter("section = 'missing_values' AND metric = 'missing_count'")
    .select("column", "before", "after", "change"),
    f"""SELECT b."column", CAST(b.missing_count AS DOUBLE) AS before, CAST(a.missing_count AS DOUBLE) AS after,
        CAST(a.missing_count - b.missing_count AS DOUBLE) AS change
        FROM ({missing_sql('locations', LOCATION_COLUMNS)}) b JOIN ({missing_sql(AFTER, LOCATION_COLUMNS)}) a USING ("column")""",
)
