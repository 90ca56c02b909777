"""First few non-missing values of every column, in a given row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window as W

from poiscope.functions.exprs import col, present

# Rows of the table head looked at first; a constant, whatever the table size.
HEAD_ROWS = 100


def leading_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], count: int) -> DataFrame:
    """(column, samples): up to `count` values per column joined with ', '.

    Nearly all columns are settled by the first rows of the table. Those are found by a top-k
    over the order keys alone, whose last key then is a filter for the scan. Only columns too
    sparse to have `count` values there are looked up in the whole table, where by then only
    their non-missing values travel, and of these `count` per task.
    """
    order = [col(o).asc_nulls_last() for o in order_by]
    lead = order_by[0]
    last = (
        df.select(*[col(o) for o in order_by]).orderBy(*order).limit(HEAD_ROWS)
        .agg(F.count(F.lit(1)).alias("rows"), F.count(col(lead)).alias("keyed"), F.max(col(lead)).cast("string").alias("bound"))
        .first()
    )
    whole_seen = last["rows"] < HEAD_ROWS
    needed = list(dict.fromkeys([*columns, *order_by]))
    head = df.select(*[col(c) for c in needed])
    if not whole_seen and last["keyed"] == last["rows"]:
        head = head.filter(col(lead) <= F.lit(last["bound"]).cast(df.schema[lead].dataType))
    head = head.orderBy(*order).limit(HEAD_ROWS)
    filled = head.agg(*[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sparse = [c for i, c in enumerate(columns) if filled[f"n{i}"] < count and not whole_seen]
    dense = [c for c in columns if c not in sparse]
    frames = [_ranked(frame, df, cols, order_by, count) for frame, cols in ((head, dense), (df, sparse)) if cols]
    out = frames[0]
    for extra in frames[1:]:
        out = out.unionByName(extra)
    return out


def _ranked(frame: DataFrame, schema_of: DataFrame, columns: Sequence[str], order_by: Sequence[str], count: int) -> DataFrame:
    keys = [col(o).alias(f"_k{i}") for i, o in enumerate(order_by)]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), present(schema_of, c).cast("string").alias("value")) for c in columns]
    )
    order = [F.col(f"_k{i}").asc_nulls_last() for i in range(len(order_by))]
    rank = F.row_number().over(W.partitionBy("column").orderBy(*order))
    return (
        frame.select(*keys, F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= count)
        .groupBy("column")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda s: s["value"]), ", ").alias("samples"))
    )
