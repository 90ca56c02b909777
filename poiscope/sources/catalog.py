"""Tables and views of the session."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from poiscope.functions.exprs import col, open_retail
from poiscope.plans.longform import union_all
from poiscope.plans.quantiles import nth_smallest

# Fixed value: the sample size offered first.
DEFAULT_SAMPLE = 10_000


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of all tables and views of the current database."""
    rows = [(t.name,) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string").orderBy("name")


def require_table(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name!r} does not exist")


def table_catalog(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(name, row_count, column_count) of the given tables; at least one."""
    if not frames:
        raise ValueError("no tables given")
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("name"), "row_count", F.lit(len(df.columns)).alias("column_count")
            )
            for name, df in frames.items()
        ]
    )


def session_catalog(spark: SparkSession, names: Iterable[str] | None = None) -> DataFrame:
    """`table_catalog` of the tables of the session."""
    wanted = list(names) if names is not None else [t.name for t in spark.catalog.listTables()]
    if not wanted:
        return spark.createDataFrame([], "name string, row_count bigint, column_count int")
    return table_catalog({n: spark.table(n) for n in wanted})


def scan_table(spark: SparkSession, name: str, sample_size: int | None = None) -> DataFrame:
    """A table, or its first `sample_size` rows as the engine finds them."""
    require_table(spark, name)
    df = spark.table(name)
    return df.limit(sample_size) if sample_size and sample_size > 0 else df


def random_sample(df: DataFrame, key: Sequence[str], n: int = DEFAULT_SAMPLE, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all, if fewer), the same ones for the same seed; the key must be unique.

    Rows are ranked by a hash of their key. The n-th smallest rank is found by radix selection; what is below it is a
    plain filter of the table, so no task orders the sample. Only rows that tie with it in the first 52 bits of
    the hash, nearly always none, are ordered by the rest.
    """
    if n < 0:
        raise ValueError("sample size must not be negative")
    if n == 0:
        return df.limit(0)
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in key]))
    ranked = df.withColumn("_rank", rank).withColumn("_lead", F.conv(F.substring("_rank", 1, 13), 16, 10).cast("double"))
    found = nth_smallest(ranked, "_lead", n)
    if found is None:
        return df
    lead, ties, wanted = found
    kept = ranked.filter(F.col("_lead") <= lead)
    if wanted < ties:
        at = ranked.filter(F.col("_lead") == lead).orderBy("_rank", *[col(k).asc_nulls_last() for k in key]).limit(wanted)
        kept = ranked.filter(F.col("_lead") < lead).unionByName(at)
    return kept.drop("_rank", "_lead")


def filtered_view(df: DataFrame, view: str) -> DataFrame:
    """Register the open retail locations as a temporary view."""
    kept = open_retail(df)
    kept.createOrReplaceTempView(view)
    return kept.sparkSession.table(view)


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Ad-hoc SQL; frames are available under their names in braces."""
    return spark.sql(text, **frames) if frames else spark.sql(text)


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """First n rows, of a given order if one is named."""
    return df.orderBy(*[col(o).asc_nulls_last() for o in order_by]).limit(n) if order_by else df.limit(n)
