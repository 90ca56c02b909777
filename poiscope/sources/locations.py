"""The `locations` table the checks run on, derived from orders, customer and nation.

The provided tables have no missing values and no duplicate rows; this derivation plants both,
and every other defect the operators look for, at known rates (see FIXTURES.md). The text below
is plain enough to mean the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession, functions as F

from poiscope.plans.durable import shared_dir

COPIED_EVERY = 157  # every location whose id divides by this appears twice

BASE_SQL = """
SELECT
  o.o_orderkey AS location_id,
  CASE WHEN o.o_orderkey % 211 = 0 THEN NULL
       WHEN o.o_orderkey % 331 = 7 THEN 'CafÃ© ' || CAST(o.o_orderkey % 50 AS STRING)
       WHEN c.c_custkey % 3 = 0 THEN 'Chain ' || CAST(c.c_custkey % 60 AS STRING)
       ELSE 'Shop ' || CAST(o.o_orderkey % 9000 AS STRING) END AS name,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'ch' || CAST(c.c_custkey % 60 AS STRING)
       WHEN c.c_custkey % 3 = 1 THEN '' ELSE NULL END AS chain_id,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'Chain ' || CAST(c.c_custkey % 60 AS STRING) END AS chain_name,
  CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'retail'
       WHEN 'FURNITURE' THEN 'convenience_and_grocery_stores'
       WHEN 'MACHINERY' THEN 'dining'
       WHEN 'BUILDING' THEN 'services' ELSE 'retail' END AS main_category,
  CASE WHEN o.o_orderkey % 41 = 0 THEN NULL WHEN o.o_orderkey % 43 = 0 THEN ''
       ELSE 'sub_' || CAST((o.o_orderkey * o.o_orderkey) % 17 AS STRING) END AS sub_category,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 97 = 0 THEN ''
       WHEN o.o_orderkey % 89 = 0 THEN '1 Elm'
       ELSE CAST(o.o_orderkey % 5000 AS STRING) || ' Main Street' END AS address,
  CASE WHEN o.o_orderkey % 37 = 0 THEN NULL
       ELSE 'City ' || CAST((o.o_orderkey * o.o_orderkey) % 400 AS STRING) END AS city,
  n.n_name AS state,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL
       WHEN o.o_orderkey % 29 = 0 THEN lpad(CAST(c.c_custkey % 90 AS STRING), 5, '0') || '-' || lpad(CAST(o.o_orderkey % 10000 AS STRING), 4, '0')
       WHEN o.o_orderkey % 59 = 0 THEN CAST(c.c_custkey % 1000 AS STRING)
       ELSE lpad(CAST(c.c_custkey % 90 AS STRING), 5, '0') END AS postal_code,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL WHEN o.o_orderkey % 503 = 0 THEN CAST(123 AS DOUBLE)
       ELSE CAST(43 AS DOUBLE) + CAST(o.o_custkey % 97 AS DOUBLE) / 128 END AS latitude,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL WHEN o.o_orderkey % 509 = 0 THEN CAST(-200 AS DOUBLE)
       ELSE CAST(-116 AS DOUBLE) + CAST(o.o_custkey % 89 AS DOUBLE) / 128 END AS longitude,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL
       ELSE 'https://shop' || CAST(o.o_orderkey AS STRING) || '.example.com' END AS website,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 61 = 0 THEN 'call us'
       ELSE '+1 208 555 ' || lpad(CAST(o.o_orderkey % 10000 AS STRING), 4, '0') END AS phone,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
       ELSE 'info' || CAST(o.o_orderkey AS STRING) || '@example.com' END AS email,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL
       ELSE lpad(CAST(6 + o.o_orderkey % 5 AS STRING), 2, '0') || ':00:00' END AS monday_open,
  CASE WHEN o.o_orderkey % 3 = 0 OR o.o_orderkey % 31 = 0 THEN NULL
       WHEN o.o_orderkey % 47 = 0 THEN '02:00:00'
       ELSE lpad(CAST(15 + o.o_orderkey % 8 AS STRING), 2, '0') || ':30:00' END AS monday_close,
  CASE WHEN (o.o_orderkey + 1) % 3 = 0 THEN NULL
       ELSE lpad(CAST(7 + o.o_orderkey % 4 AS STRING), 2, '0') || ':00:00' END AS tuesday_open,
  CASE WHEN (o.o_orderkey + 1) % 3 = 0 THEN NULL
       ELSE lpad(CAST(16 + o.o_orderkey % 7 AS STRING), 2, '0') || ':00:00' END AS tuesday_close,
  CASE WHEN (o.o_orderkey + 2) % 3 = 0 THEN NULL
       ELSE lpad(CAST(7 + o.o_orderkey % 4 AS STRING), 2, '0') || ':00:00' END AS wednesday_open,
  CASE WHEN (o.o_orderkey + 2) % 3 = 0 THEN NULL
       ELSE lpad(CAST(16 + o.o_orderkey % 7 AS STRING), 2, '0') || ':00:00' END AS wednesday_close,
  CASE WHEN (o.o_orderkey + 3) % 3 = 0 THEN NULL
       ELSE lpad(CAST(7 + o.o_orderkey % 4 AS STRING), 2, '0') || ':00:00' END AS thursday_open,
  CASE WHEN (o.o_orderkey + 3) % 3 = 0 THEN NULL
       ELSE lpad(CAST(16 + o.o_orderkey % 7 AS STRING), 2, '0') || ':00:00' END AS thursday_close,
  CASE WHEN (o.o_orderkey + 4) % 3 = 0 THEN NULL
       ELSE lpad(CAST(7 + o.o_orderkey % 4 AS STRING), 2, '0') || ':00:00' END AS friday_open,
  CASE WHEN (o.o_orderkey + 4) % 3 = 0 THEN NULL
       ELSE lpad(CAST(16 + o.o_orderkey % 7 AS STRING), 2, '0') || ':00:00' END AS friday_close,
  CASE WHEN (o.o_orderkey + 5) % 2 = 0 THEN NULL
       ELSE lpad(CAST(7 + o.o_orderkey % 4 AS STRING), 2, '0') || ':00:00' END AS saturday_open,
  CASE WHEN (o.o_orderkey + 5) % 2 = 0 THEN NULL
       ELSE lpad(CAST(16 + o.o_orderkey % 7 AS STRING), 2, '0') || ':00:00' END AS saturday_close,
  CASE WHEN (o.o_orderkey + 6) % 2 = 0 THEN NULL
       ELSE lpad(CAST(7 + o.o_orderkey % 4 AS STRING), 2, '0') || ':00:00' END AS sunday_open,
  CASE WHEN (o.o_orderkey + 6) % 2 = 0 THEN NULL
       ELSE lpad(CAST(16 + o.o_orderkey % 7 AS STRING), 2, '0') || ':00:00' END AS sunday_close,
  CASE o.o_orderstatus WHEN 'P' THEN 'closed' ELSE 'open' END AS open_closed_status,
  CAST(o.o_orderdate AS DATE) AS opened_on,
  CASE WHEN o.o_orderkey % 71 = 35 THEN 'unknown'
       ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS opened_date_text,
  CAST((o.o_orderkey * 37) % 128 AS DOUBLE) / 128 AS data_quality_confidence_score,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderkey % 101 AS DOUBLE) END AS popularity_score,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderkey % 64 AS DOUBLE) / 64 END AS sentiment_score,
  CAST(5 + o.o_orderkey % 120 AS DOUBLE) AS dwell_time,
  CASE WHEN o.o_orderkey % 401 = 0 THEN o.o_totalprice * 16 ELSE o.o_totalprice END AS price_amount,
  CAST(o.o_orderkey % 1000 AS STRING) AS store_number_text,
  '{"k": ' || CAST(o.o_orderkey % 100 AS STRING) || '}' AS props
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

# The same rows for the comparison engine, as the head of a query.
LOCATIONS_CTE = f"""WITH base AS ({BASE_SQL}),
locations AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE location_id % {COPIED_EVERY} = 0)
"""


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def locations(spark: SparkSession, directory: str) -> DataFrame:
    """Derive the locations from one pass over the orders; copies are emitted in place."""
    sql = BASE_SQL.replace("{", "{{").replace("}", "}}")
    for table, alias in (("orders", "o"), ("customer", "c"), ("nation", "n")):
        sql = sql.replace(f" {table} {alias}", f" {{{table}}} {alias}")
    base = spark.sql(sql, **{t: read_table(spark, directory, t) for t in ("orders", "customer", "nation")})
    copies = F.when(F.col("location_id") % COPIED_EVERY == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("_copy", F.explode(copies)).drop("_copy")


_STORED: dict[tuple[str, str], str] = {}


def stored_locations(spark: SparkSession, directory: str) -> DataFrame:
    """The locations as a Parquet table, derived once per application into the shared folder.

    A points-of-interest table is stored data, not a view over orders; reading it as such lets
    every query prune its columns and push its filters into the scan.
    """
    key = (spark.sparkContext.applicationId, directory)
    if key not in _STORED:
        path = f"{shared_dir(spark).rstrip('/')}/locations-{key[0]}-{sha1(directory.encode()).hexdigest()[:12]}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        locations(spark, directory).repartition(parts).write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
