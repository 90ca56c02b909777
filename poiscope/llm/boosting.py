"""Gradient-boosted trees over a column of dense features, with Spark's own learner."""

from __future__ import annotations

from math import isqrt

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from poiscope.plans.durable import scratch_path


def bounded_sample(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` labelled rows, those with the smallest hashes of their key.

    Hashes are spread evenly, so a threshold from the exact number of rows leaves little more than `most` of them to order,
    however many tasks there are.
    """
    rows, wanted = labelled.count(), most + 6 * isqrt(most) + 10
    if rows <= most:
        return labelled
    near = labelled
    if wanted < rows:
        threshold = 2**64 * wanted // rows - 2**63
        near = labelled.filter(F.xxhash64(key) < F.lit(min(threshold, 2**63 - 1)))
    return near.orderBy(F.xxhash64(key), key).limit(most)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, for work that reads them many times."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_trees(rows: DataFrame, trees: int = 20, depth: int = 4, step: float = 0.3) -> GBTClassificationModel | float:
    """A model of (features array<double>, label 0/1); the one label's value if there is no other, 0 if none."""
    seen = [r[0] for r in rows.select("label").distinct().collect()]
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.0
    learner = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, seed=1, checkpointInterval=-1
    )
    prepared = rows.select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label"))
    return learner.fit(prepared.coalesce(4))


def probability(df: DataFrame, model: GBTClassificationModel | float, into: str) -> DataFrame:
    """Adds the probability of label 1 for the column `features`."""
    if isinstance(model, float):
        return df.withColumn(into, F.lit(model))
    scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p").transform(
        df.withColumn("vector", array_to_vector("features"))
    )
    return scored.withColumn(into, vector_to_array("_p")[1]).drop("vector", "_p")
