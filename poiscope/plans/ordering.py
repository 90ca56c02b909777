"""Global order without a single-task window.

Rows fall into contiguous slices of the order at literal splitters, so the number of a slice is a function of the row:
nothing has to be kept for later steps to see the same slices, and a task that runs again after a lost executor
agrees with the first. Splitters come from a sample of the keys; they decide how even the slices are and nothing
else. What a slice needs from the others is one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from poiscope.functions.exprs import col, quoted, text_literal

SLICE = "_slice"
#: Bytes of a slice by the engine's estimate of the table, rows worth a slice, slices at most, sampled keys per slice,
#: splitters in a block.
SLICE_BYTES = 64 << 20
LEAST_ROWS = 10_000
MOST_SLICES = 4096
SAMPLED = 50
BLOCK = 32


def _slices_for(df: DataFrame, rows: int) -> int:
    """Enough slices for the estimated bytes, unless rows are few; at least one per core."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = min(MOST_SLICES, ceil(size / SLICE_BYTES), ceil(rows / LEAST_ROWS))
    return max(wanted, df.sparkSession.sparkContext.defaultParallelism)


def splitters(df: DataFrame, keys: Sequence[str], slices: int | None) -> list[str]:
    """SQL of rising key tuples that cut the rows into about equal slices; what reaches the driver is `SAMPLED` keys a slice."""
    fields = [df.schema[k] for k in keys]
    narrow = df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = narrow.count()
    slices = slices or _slices_for(df, rows)
    wanted = SAMPLED * slices
    sample = narrow if rows <= wanted else narrow.sample(fraction=wanted / rows, seed=1)

    # Values as texts that are read back exactly.
    written = {"binary": F.hex, "timestamp": lambda c: F.unix_micros(c).cast("string")}
    read = {"binary": "unhex({})", "timestamp": "timestamp_micros(CAST({} AS BIGINT))"}
    kinds = [f.dataType.simpleString() for f in fields]
    said = [written.get(kind, lambda c: c.cast("string"))(F.col(f"k{i}")).alias(f"s{i}") for i, kind in enumerate(kinds)]
    found = sample.orderBy(*narrow.columns).select(*said).collect()
    cuts = dict.fromkeys(tuple(found[len(found) * i // slices]) for i in range(1, slices)) if found else {}

    def literal(value: str | None, kind: str) -> str:
        return f"CAST({read.get(kind, '{}').format(text_literal(value))} AS {kind})"

    return ["named_struct(" + ", ".join(f"'k{i}', {literal(*x)}" for i, x in enumerate(zip(cut, kinds))) + ")" for cut in cuts]


def sliced(df: DataFrame, keys: Sequence[str], cuts: Sequence[str]) -> DataFrame:
    """The rows with the number of their slice in the ascending order of the keys (NULLs first), in `_slice`."""
    key = "named_struct(" + ", ".join(f"'k{i}', {quoted(k)}" for i, k in enumerate(keys)) + ")"

    def upto(ordered: str) -> str:
        return f"size(filter({ordered}, _cut_ -> _cut_ <= {key}))"

    if len(cuts) <= BLOCK:
        return df.withColumn(SLICE, F.expr(upto(f"array({', '.join(cuts)})")) if cuts else F.lit(0))
    # The last splitter of each whole block first, then those of one block.
    numbered = df.withColumn("_block", F.expr(upto(f"array({', '.join(cuts[BLOCK - 1 :: BLOCK])})")))
    here = upto(f"slice(array({', '.join(cuts)}), _block * {BLOCK} + 1, {BLOCK})")
    return numbered.withColumn(SLICE, F.expr(f"_block * {BLOCK} + {here}")).drop("_block")


def _own_slice() -> Column:
    """The slice as a join key. Between two plain columns the optimizer would carry the definition of one, with its
    lambda, over to the other side, where the columns it reads are not."""
    return F.abs(SLICE)


def with_index(df: DataFrame, order: Sequence[str], name: str, slices: int | None = None) -> DataFrame:
    """0-based position in the global order of unique keys, without NULL."""
    cuts = splitters(df, order, slices)
    cut = sliced(df, order, cuts)
    names = [f"_o{i}" for i in range(len(order))]
    narrow = sliced(df.select(*[col(o).alias(n) for o, n in zip(order, names)]), names, cuts)
    sizes = narrow.groupBy(F.col(SLICE).alias("_s_slice")).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_s_slice", (F.sum("_size").over(W.orderBy("_s_slice")) - F.col("_size")).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(SLICE).orderBy(*[col(o) for o in order]))
    return (
        cut.join(F.broadcast(offsets), _own_slice() == F.col("_s_slice"))  # one row per slice
        .withColumn(name, (F.col("_offset") + inside - 1).cast("long"))
        .drop(SLICE, "_s_slice", "_offset")
    )


def fill_along(
    df: DataFrame,
    column: str,
    order: Sequence[str],
    partition_by: Sequence[str] = (),
    backward: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Replace NULL by the nearest earlier (or later) value; the order keys must be unique and not NULL.

    A partition key held by many rows is cut into slices like everything else, so its size does not matter. Whole
    rows are shuffled once; what is carried between slices is read from the keys and the filled column alone.
    """
    keys = [col(k) for k in partition_by]
    cuts = splitters(df, [*partition_by, *order], slices)
    cut = sliced(df, [*partition_by, *order], cuts)
    n_keys, n_order = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    named = zip([*partition_by, *order, column], [*n_keys, *n_order, "_v"])
    narrow = sliced(df.select(*[col(c).alias(n) for c, n in named]), [*n_keys, *n_order], cuts)

    # Last value of each key in each slice. Only the first key of a slice can have begun in an earlier one, so the
    # rows that are carried into a slice are at most one (backward: the last key, and a later slice).
    pick = F.min_by if backward else F.max_by
    place = F.when(F.col("_v").isNotNull(), F.struct(*n_order))
    tails = narrow.groupBy(SLICE, *n_keys).agg(pick("_v", place).alias("_tail"))
    by_slice = F.col(SLICE).desc() if backward else F.col(SLICE)
    before = W.partitionBy(*n_keys).orderBy(by_slice).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before))
        .filter(F.col("_carry").isNotNull())
        .select(F.col(SLICE).alias("_c_slice"), *[F.col(k).alias(f"_c_key{i}") for i, k in enumerate(n_keys)], "_carry")
    )
    same = _own_slice() == F.col("_c_slice")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_c_key{i}"))
    direction = [col(o).desc() if backward else col(o) for o in order]
    within = W.partitionBy(SLICE, *keys).orderBy(*direction).rowsBetween(W.unboundedPreceding, -1)
    filled = F.coalesce(col(column), F.last(col(column), ignorenulls=True).over(within), F.col("_carry"))
    return (
        cut.join(F.broadcast(carried), same, "left")
        .withColumn("_filled", filled)
        .select(*[F.col("_filled").alias(c) if c == column else col(c) for c in df.columns])
    )
