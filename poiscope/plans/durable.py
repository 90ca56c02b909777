"""Cutting lineage into storage that outlives an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Paths handed out, by application.
_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint directory.

    A session that names none gets a temporary folder if it runs in one process; on a cluster that
    folder would be out of reach of the executors, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        configured = tempfile.mkdtemp(prefix="poiscope-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to fresh paths; frames that read them end with it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for text in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(conf).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so later reads see the very same rows and layout."""
    spark = df.sparkSession
    directory = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(directory)
    return df.checkpoint(eager=True)
