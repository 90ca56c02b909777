"""Connected components of a table of links, and lookups that split hot keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.boosting import written

SLICES = 64
SIEVE_BITS = 1 << 26
MAP_BYTES = 4096  # of the engine's bitmaps


def slice_of(row_id: Column) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(SLICES)).cast("int")


def slices_seen() -> Column:
    """Aggregate over a column `_slice`: bit mask of the slices that occur."""
    return F.bit_or(F.expr("shiftleft(1L, _slice)"))


def per_slice(groups: DataFrame, mask: str = "_slices") -> DataFrame:
    """Each group once for every slice in its mask, as column `_slice`: never more rows than the group has."""
    each = F.filter(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.getbit(F.col(mask), i) == 1)
    return groups.withColumn("_slice", F.explode(each)).drop(mask)


def sieved(df: DataFrame, column: str, ids: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """The rows whose id is among `ids` (one column), and some others: what a join with them need not shuffle is gone.

    The sieve is a bitmap of id hashes of a fixed size, whatever the number of ids; the more ids, the less it holds back.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # bitmaps begin at 1
    held = ids.select(place(F.col(ids.columns[0])).alias("place"))
    maps = held.groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("map")
    )
    flat = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        at = (row["bucket"] - 1) * MAP_BYTES
        flat[at : at + MAP_BYTES] = np.frombuffer(row["map"], np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(flat)

    @F.pandas_udf("boolean")
    def passes(places: pd.Series) -> pd.Series:
        at = places.to_numpy() - 1
        return pd.Series((sent.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return df.filter(F.col(column).isNotNull()).filter(passes(place(F.col(column))))


def forget(table: DataFrame | None) -> None:
    """Removes the files of a table in the shared folder that nothing will read again."""
    if table is None or not (files := table.inputFiles()):
        return
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links (u, v), the component named by its smallest node.

    Alternates two steps until nothing changes: neighbours larger than a node move to its smallest neighbour, then the
    smaller ones do. Each turn is written to the shared folder.
    """

    def towards_least(both: DataFrame, larger: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        joined = both.join(least, "u")
        if larger:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = joined.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return moved.unionByName(least.select("u", F.col("low").alias("v")))

    def tidy(edges: DataFrame) -> DataFrame:
        return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = written(tidy(links), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tidy(towards_least(both, True))
        last, edges = edges, written(tidy(towards_least(large, False)), "links")
        forget(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
