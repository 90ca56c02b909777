"""Files in and out: CSV, Parquet, JSON results and a manifest of file contents."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

# Written for NULL, so that it stays apart from an empty string.
NULL_MARK = r"\N"
STAMP = "%Y%m%d%H%M%S"


def read_csv(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the data once more.

    Large files are split among tasks. Files whose quoted values span lines need `multi_line`, and
    one file is then read by one task. Records that do not fit are an error, so values over several
    lines are not torn silently.
    """
    reader = spark.read.options(header="true", escape='"', multiLine=str(multi_line).lower(), mode="FAILFAST")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read by file extension; `multi_line` is for CSV."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension == ".csv":
        return read_csv(spark, path, multi_line=multi_line)
    if extension == ".parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported file format {extension!r}; use CSV or Parquet")


def register_loaded_file(
    spark: SparkSession, path: str, now: datetime | None = None, multi_line: bool = False
) -> tuple[str, DataFrame]:
    """Load a file into a new table `<file>_<yyyymmddHHMMSS>`; returns its name and the table."""
    df = read_any(spark, path, multi_line)
    stem = re.sub(r"[^A-Za-z0-9_]", "_", os.path.basename(path.rstrip("/")).split(".")[0])
    name = f"{stem}_{(now or datetime.now()).strftime(STAMP)}"
    df.write.mode("errorifexists").saveAsTable(name)
    return name, spark.table(name)


def export_csv(results: Mapping[str, DataFrame], directory: str) -> dict[str, str]:
    """Write every result as CSV under `directory/<name>`."""
    paths = {}
    for name, df in results.items():
        paths[name] = f"{directory.rstrip('/')}/{name}"
        df.write.mode("overwrite").options(
            header="true", nullValue=NULL_MARK, escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
        ).csv(paths[name])
    return paths


def read_exported_csv(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    """Read back what `export_csv` wrote; `multi_line` where values hold line breaks."""
    options = {"header": "true", "nullValue": NULL_MARK, "escape": '"', "multiLine": str(multi_line).lower(), "mode": "FAILFAST"}
    return spark.read.options(**options).schema(schema).csv(path)


def export_results_json(metrics: DataFrame, directory: str, name: str, now: datetime | None = None) -> str:
    """Write a metrics frame as JSON lines under `directory/<name>_<yyyymmdd_HHMMSS>`."""
    path = f"{directory.rstrip('/')}/{name}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    metrics.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return path


def manifest(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, length, digest) per row: size of the content in bytes and its MD5."""
    value = F.col(content)
    return df.select(
        F.col(key).alias("key"), F.octet_length(value).cast("long").alias("length"), F.md5(value.cast("binary")).alias("digest")
    )


def file_manifest(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(key, length, digest) of the files below a directory, the key being the path.

    Files pass through one row each; the reader refuses files of more than 2 GiB.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    return manifest(listed, "path", "content")


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change): added, removed or modified entries between two manifests."""
    old = before.select("key", F.col("digest").alias("old"), F.lit(True).alias("was"))
    new = after.select("key", F.col("digest").alias("new"), F.lit(True).alias("is"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    return old.join(new, "key", "full_outer").withColumn("change", change).filter(F.col("change").isNotNull()).select("key", "change")
