"""Sources, catalog and exports. Written copies go to a fresh path in the session's shared folder."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from poiscope.checks.columns import LINEITEM_COLUMNS
from poiscope.checks.location_queries import DENSITY, OPEN, RETAIL
from poiscope.checks.profile_queries import missing_sql
from poiscope.checks.registry import query
from poiscope.operators import cleaning, locations as analyses, profile
from poiscope.plans.durable import scratch_path
from poiscope.sources import catalog, files, sinks

# The provided tables with their numbers of columns.
TABLE_WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}

query(
    "table_catalog",
    lambda t: catalog.table_catalog({n: getattr(t, n) for n in TABLE_WIDTHS}),
    " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS row_count, {w} AS column_count FROM {n}" for n, w in TABLE_WIDTHS.items()),
    on_locations=False,
)


def _scanned(t):
    view = "poiscope_scanned_events"
    t.events.createOrReplaceTempView(view)
    return catalog.scan_table(t.spark, view)


query("scan_table", _scanned, "SELECT * FROM events", on_locations=False)
query(
    "random_sample",
    lambda t: catalog.random_sample(t.orders, ["o_orderkey"], 1000, seed=7),
    "SELECT * FROM orders ORDER BY md5('7:' || o_orderkey) LIMIT 1000",
    on_locations=False,
)
query(
    "filtered_view",
    lambda t: catalog.filtered_view(t.locations, "poiscope_open_retail"),
    f"SELECT * FROM locations WHERE {OPEN} AND {RETAIL}",
)
query(
    "run_sql",
    lambda t: catalog.run_sql(
        t.spark,
        "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice > 100000 GROUP BY o_orderpriority",
        orders=t.orders,
    ),
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority",
    on_locations=False,
)
query(
    "preview",
    lambda t: catalog.preview(t.documents, 10, ["doc_id"]),
    "SELECT * FROM documents ORDER BY doc_id LIMIT 10",
    on_locations=False,
)


def _csv_copy(t):
    """The POI table written as CSV and read back, NULLs and empty strings included."""
    df = t.locations.select("location_id", "name", "chain_id", "address", "latitude", "opened_on")
    path = files.export_csv({"copy": df}, scratch_path(t.spark, "csv"))["copy"]
    return files.read_exported_csv(t.spark, path, df.schema)


query("export_csv", _csv_copy, "SELECT location_id, name, chain_id, address, latitude, opened_on FROM locations")


def _csv_documents(t):
    """Whole texts, with their quotes and line breaks."""
    path = files.export_csv({"documents": t.documents}, scratch_path(t.spark, "csv"))["documents"]
    return files.read_exported_csv(t.spark, path, t.documents.schema, multi_line=True)


query("export_csv_documents", _csv_documents, "SELECT * FROM documents", on_locations=False)


def _csv_result(t):
    df = analyses.competitive_density(t.locations)
    path = files.export_csv({"density": df}, scratch_path(t.spark, "csv"))["density"]
    return files.read_exported_csv(t.spark, path, df.schema)


query("export_csv_result", _csv_result, DENSITY + " LIMIT 10")


def _inferred_csv(t):
    path = files.export_csv({"part": t.part}, scratch_path(t.spark, "csv"))["part"]
    return files.read_csv(t.spark, path).selectExpr(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


query(
    "read_csv",
    _inferred_csv,
    "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    on_locations=False,
)
query(
    "read_parquet",
    lambda t: files.read_parquet(t.spark, f"{t.directory}/supplier.parquet"),
    "SELECT * FROM supplier",
    on_locations=False,
)


def _json_copy(t):
    metrics = profile.missing_values(t.lineitem)
    path = files.export_results_json(metrics, scratch_path(t.spark, "json"), "missing")
    return t.spark.read.schema(metrics.schema).json(path)


query("export_results_json", _json_copy, missing_sql("lineitem", LINEITEM_COLUMNS), on_locations=False)
query(
    "manifest_documents",
    lambda t: files.manifest(t.documents, "doc_id", "text"),
    "SELECT doc_id AS key, CAST(strlen(text) AS BIGINT) AS length, md5(text) AS digest FROM documents",
    on_locations=False,
)
query(
    "manifest_pages",
    lambda t: files.manifest(t.pages, "url", "html"),
    "SELECT url AS key, CAST(strlen(html) AS BIGINT) AS length, md5(html) AS digest FROM pages",
    on_locations=False,
)
query(
    "manifest_changes",
    lambda t: files.manifest_changes(
        files.manifest(t.documents.selectExpr("doc_id * 2 AS doc_id", "text"), "doc_id", "text"),
        files.manifest(t.documents.selectExpr("doc_id * 3 AS doc_id", "replace(text, 'an', 'en') AS text"), "doc_id", "text"),
    ),
    """SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change
        FROM (SELECT doc_id * 2 AS k, text FROM documents) a
        FULL JOIN (SELECT doc_id * 3 AS k, replace(text, 'an', 'en') AS text FROM documents) b ON a.k = b.k
        WHERE a.k IS NULL OR b.k IS NULL OR a.text <> b.text""",
    on_locations=False,
)

VIEWS = "poiscope_listed_"


def _listed(t):
    """Views of all tables as the session lists them, each required to exist and counted."""
    for name in TABLE_WIDTHS:
        getattr(t, name).createOrReplaceTempView(VIEWS + name)
    names = [r["name"] for r in catalog.list_tables(t.spark).filter(F.col("name").startswith(VIEWS)).collect()]
    for name in names:
        catalog.require_table(t.spark, name)
    return catalog.table_catalog({name: catalog.scan_table(t.spark, name) for name in names})


query(
    "list_tables",
    _listed,
    " UNION ALL ".join(f"SELECT '{VIEWS}{n}' AS name, count(*) AS row_count, {w} AS column_count FROM {n}" for n, w in TABLE_WIDTHS.items()),
    on_locations=False,
)


def _stamped(t) -> tuple[str, datetime]:
    """A table name and a time nobody else uses."""
    return f"poi_{uuid.uuid4().hex}", datetime.now()


def _loaded(t):
    """Written as CSV, loaded into a table of the catalog and read from there."""
    path = files.export_csv({"customer": t.customer}, scratch_path(t.spark, "loaded"))["customer"]
    copy = f"{scratch_path(t.spark, 'parquet')}/{_stamped(t)[0]}.parquet"
    files.read_exported_csv(t.spark, path, t.customer.schema).write.parquet(copy)
    return files.register_loaded_file(t.spark, copy)[1]


query("register_loaded_file", _loaded, "SELECT * FROM customer", on_locations=False)


def _saved(t):
    name, now = _stamped(t)
    return t.spark.table(sinks.save_cleaned(cleaning.basic_clean(t.locations).frame, name, now))


def _replaced(t):
    name, _ = _stamped(t)
    sinks.replace_cleaned(t.supplier, name)
    return t.spark.table(sinks.replace_cleaned(t.part, name))


query("save_cleaned", _saved, "SELECT DISTINCT * REPLACE (coalesce(address, 'Unknown') AS address) FROM locations")
query("replace_cleaned", _replaced, "SELECT * FROM part", on_locations=False)
