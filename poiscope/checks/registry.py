"""Registry of queries: a name, the Spark form and, where SQL can say it, the SQL form."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from poiscope.sources.locations import LOCATIONS_CTE, locations, read_table, stored_locations


class Tables:
    """Lazy access to the tables of one directory: `t.lineitem`, `t.locations`, ..."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = str(directory).rstrip("/")

    @cached_property
    def locations(self) -> DataFrame:
        """Stored once where the session names a shared folder, else derived in each query."""
        named = self.spark.conf.get("spark.checkpoint.dir", None)
        return stored_locations(self.spark, self.directory) if named else locations(self.spark, self.directory)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.directory, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, on_locations: bool = True) -> None:
    """Register a query; `sql` may use `locations` unless on_locations is off."""
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = lambda spark, directory: build(Tables(spark, directory))
    if sql is not None:
        if on_locations:
            head = sql.lstrip()
            more = head[:5].upper() == "WITH "
            SQL[name] = LOCATIONS_CTE + (", " + head[5:] if more else head)
        else:
            SQL[name] = sql.strip()
