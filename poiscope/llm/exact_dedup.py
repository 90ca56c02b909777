"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are combined three times: inside the task that read them, among the tasks of one salt, and
globally. Each time the grouping key holds the digest and the whole normalised text, so a digest
shared by different texts never merges them.

Every row finds its group again without its text: a group remembers in a bit mask which of 64
slices of the ids it has rows in, and is sent once to each of these, so a group holding a third of
all rows is looked up in 64 places and a single row in one. Should different texts share a digest,
the rows of that digest alone are compared by text.

Defined results: a null text counts as empty; an id that is null loses to any other; rows that
repeat one id with equal texts are one document, kept or dropped together, and each counts in
group_size. Other columns of the input are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from poiscope.llm.common import SPACE_CLASS, whole
from poiscope.plans.durable import scratch_path

SLICES = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(whole(text), SPACE_CLASS + "+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    merge_salts: int = 32,
    carry: bool = False,
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row; `carry` adds the whole row as struct `row`.

    merge_salts: in how many groups of tasks the copies of one text are merged before the global merge.
    """
    text = F.col("_text")
    base = docs.select(
        F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"), *[F.struct("*").alias("_row")] * carry
    )
    keyed = base.select("_id", "_text", digest(text).alias("_key"), *["_row"] * carry).withColumn(
        "_slice", F.pmod(F.xxhash64("_id"), F.lit(SLICES)).cast("int")
    )
    # The aggregate combines inside each task first, then among the tasks of one salt.
    salted = (
        keyed.select("_key", "_text", "_id", "_slice", (F.spark_partition_id() % merge_salts).alias("_salt"))
        .groupBy("_key", "_salt", "_text")
        .agg(
            F.min("_id").alias("_keep"),
            F.count(F.lit(1)).alias("_size"),
            F.bit_or(F.expr("shiftleft(1L, _slice)")).alias("_slices"),
        )
    )
    merged = (
        salted.repartition("_key")
        .groupBy("_key", "_text")
        .agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"), F.bit_or("_slices").alias("_slices"))
    )
    # One row per digest; only where different texts share it is there more than one group, and the
    # texts are needed on. The table is written, so that they are looked up only if there are any.
    by_key = merged.groupBy("_key").agg(F.collect_list(F.struct("_text", "_keep", "_size", "_slices")).alias("_groups"))
    unique = F.size("_groups") == 1
    grouped_at = scratch_path(docs.sparkSession, "exact-groups")
    by_key.select(
        "_key",
        unique.alias("_unique"),
        F.when(~unique, F.col("_groups")).alias("_groups"),
        *[F.col("_groups")[0][c].alias(c) for c in ("_keep", "_size", "_slices")],
    ).write.parquet(grouped_at)
    grouped = docs.sparkSession.read.parquet(grouped_at)
    single = grouped.filter("_unique")
    spread = single.select(
        "_key",
        "_keep",
        "_size",
        F.explode(
            F.filter(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.getbit(F.col("_slices"), i) == 1)
        ).alias("_slice"),
    )
    rows = keyed.select("_id", "_key", "_slice", *["_row"] * carry)
    found = rows.join(spread, ["_key", "_slice"]).select("_id", "_key", "_keep", "_size", *["_row"] * carry)
    shared = grouped.filter("NOT _unique").select("_key", F.explode("_groups").alias("_g"))
    if not shared.isEmpty():
        groups = shared.select("_key", *[F.col(f"_g.{c}").alias(c) for c in ("_text", "_keep", "_size")])
        compared = keyed.join(groups, ["_key", "_text"])
        found = found.unionByName(compared.select("_id", "_key", "_keep", "_size", *["_row"] * carry))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_key").alias("digest"),
        *[F.col("_row").alias("row")] * carry,
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return exact_groups(docs, id_col, text_col, carry=True).filter("kept").select("row.*")
