"""Saving cleaned tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from poiscope.sources.files import STAMP


def save_cleaned(df: DataFrame, table: str, now: datetime | None = None) -> str:
    """Save as a new table `<table>_cleaned_<yyyymmddHHMMSS>`; an empty frame is refused."""
    if df.isEmpty():
        raise ValueError("cannot save an empty frame")
    name = f"{table}_cleaned_{(now or datetime.now()).strftime(STAMP)}"
    df.write.mode("errorifexists").saveAsTable(name)
    return name


def replace_cleaned(df: DataFrame, table: str) -> str:
    """Save as `<table>_cleaned`, replacing an earlier one. The frame must not read that table."""
    name = f"{table}_cleaned"
    df.write.mode("overwrite").saveAsTable(name)
    return name
