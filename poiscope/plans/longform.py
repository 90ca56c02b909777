"""One aggregation over many columns, turned into one row per column.

The table is scanned once per chunk of columns with plain counters, so the plan holds no row
expansion; only the resulting single row is spread out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from poiscope.functions.exprs import chunks, quoted, text_literal

# Counters per scan: keeps generated code well inside the JVM's method size.
COLUMNS_PER_SCAN = 100


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _inlined(rows: Sequence[dict[str, str]]) -> str:
    """SQL that spreads one row into the given rows of field -> expression.

    Written as SQL text because a plan over a wide table has thousands of such expressions, and
    each one built through the Python API is a call into the JVM.
    """
    structs = ("named_struct(" + ", ".join(f"'{field}', {value}" for field, value in row.items()) + ")" for row in rows)
    return f"inline(array({', '.join(structs)}))"


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    terms: dict[str, Callable[[str], str]],
    name_as: str = "column",
    positions: dict[str, int] | None = None,
) -> DataFrame:
    """Rows (column, position, row_count, <term>...) from one scan per chunk of columns.

    A term gives the SQL text of an aggregate for a column name.
    """
    if not columns:  # no rows, with the schema of the terms
        return per_column(df, df.columns[:1], terms, name_as, positions).filter(F.lit(False))
    where = positions or {c: i for i, c in enumerate(df.columns)}
    frames = []
    for part in chunks(columns, max(1, COLUMNS_PER_SCAN // max(1, len(terms)))):
        aggs = [f"{make(c)} AS {key}_{i}" for i, c in enumerate(part) for key, make in terms.items()]
        one = df.selectExpr("count(1) AS row_count", *aggs)
        rows = [
            {name_as: text_literal(c), "position": str(where[c]), "row_count": "row_count"} | {key: f"{key}_{i}" for key in terms}
            for i, c in enumerate(part)
        ]
        frames.append(one.selectExpr(_inlined(rows)))
    return union_all(frames)


def tally(
    df: DataFrame, fields: Sequence[str], entries: Sequence[tuple[Sequence[str | None], str]]
) -> DataFrame:
    """Labelled counts of one scan as rows (<fields>..., n, row_count).

    Each entry is its labels and the SQL text of the condition counted; equal counts are
    computed once.
    """
    frames = []
    for part in chunks(list(entries), COLUMNS_PER_SCAN):
        one = df.selectExpr("count(1) AS row_count", *[f"count_if({test}) AS n{i}" for i, (_, test) in enumerate(part)])
        rows = [
            dict(zip(fields, map(text_literal, labels))) | {"n": f"n{i}", "row_count": "row_count"}
            for i, (labels, _) in enumerate(part)
        ]
        frames.append(one.selectExpr(_inlined(rows)))
    return union_all(frames)


def per_text_column(
    df: DataFrame,
    columns: Sequence[str],
    terms: dict[str, Callable[[Column], Column]],
    derived: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Rows (column, position, row_count, <term>...) for terms that match or parse text.

    Each row is spread into (column, text) pairs that are combined inside the task, so one small
    piece of generated code serves all columns and one row per column and task is shuffled.
    `derived` values are computed once per pair and may be used by the terms under their names.
    Counts are 0, other terms NULL, on an empty table.
    """
    if not columns:  # no rows, with the schema of the terms
        return per_text_column(df, df.columns[:1], terms, derived).filter(F.lit(False))
    melted = df.selectExpr(_inlined([{"_target": str(i), "_text": f"CAST({quoted(c)} AS STRING)"} for i, c in enumerate(columns)]))
    text = F.col("_text")
    if derived:
        melted = melted.withColumns({name: make(text) for name, make in derived.items()})
    counted = melted.groupBy("_target").agg(
        F.count(F.lit(1)).alias("row_count"), *[make(text).alias(name) for name, make in terms.items()]
    )
    where = {c: i for i, c in enumerate(df.columns)}
    labels = [{"_target": str(i), "column": text_literal(c), "position": str(where[c])} for i, c in enumerate(columns)]
    named = df.sparkSession.range(1).selectExpr(_inlined(labels)).join(counted, "_target", "left").drop("_target")
    counts = [f.name for f in counted.schema.fields if f.dataType.typeName() == "long"]
    return named.fillna(0, subset=counts)


def spread(one_row: DataFrame, fields: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """Spread a one-row frame into several rows with the given fields."""
    structs = [F.struct(*[v.alias(f) for f, v in zip(fields, row)]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))
