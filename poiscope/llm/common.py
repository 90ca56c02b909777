"""Small helpers of the text operators."""

from __future__ import annotations

import string
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space of all text contracts, as a class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory, by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where it lies, as on one machine or a shared folder."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        known["PYTHONPATH"] = ":".join([*paths, root])
    return spark


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """True for the rows no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))
