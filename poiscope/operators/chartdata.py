"""The data behind the charts: top lists, correlations, histograms, matrices."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from poiscope.functions.exprs import chunks, col, numeric_columns, present
from poiscope.operators.grading import column_scores
from poiscope.operators.profile import missing_values
from poiscope.plans.longform import spread, union_all

CORRELATIONS_PER_SCAN = 60
COLUMNS_PER_BLOCK = 34


def top_categories(counts: DataFrame, by: str = "location_count", label: str = "category", n: int = 10) -> DataFrame:
    """The n largest rows of a category count."""
    return counts.orderBy(col(by).desc(), col(label)).limit(n)


def missing_top(df: DataFrame, n: int = 10) -> DataFrame:
    """The n columns with most missing values."""
    return missing_values(df).select("column", "missing_pct").orderBy(F.col("missing_pct").desc(), "column").limit(n)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, correlation) of every pair of numeric columns, over the rows where both have a value.

    One scan while all pairs fit in one; of wider tables co-moments are summed by blocks of columns.
    """
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    if len(pairs) > CORRELATIONS_PER_SCAN:
        return _blocked_correlations(df, columns)
    one = df.agg(*[F.corr(present(df, a).cast("double"), present(df, b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return spread(one, ("a", "b", "correlation"), [(F.lit(a), F.lit(b), F.col(f"r{i}")) for i, (a, b) in enumerate(pairs)])


def _blocked_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations from pairwise sums: a scan for the means, then one per block of columns.

    Each row is spread into its values inside the task; every value meets the columns of the block, and sums are combined
    there by the value's column. Values are taken from their mean first, so that sums of squares keep their digits.
    """
    values = df.select(*[present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    means = values.agg(*[F.avg(v) for v in values.columns]).first()
    values = values.selectExpr(*[f"v{i} - double('{m!r}') AS x{i}" if m is not None else f"v{i} AS x{i}" for i, m in enumerate(means)])
    each = ", ".join(f"named_struct('i', {i}, 'x', x{i})" for i in range(len(columns)))
    sums = {"n": "count(x{j})", "s": "sum(x) FILTER (WHERE x{j} IS NOT NULL)", "q": "sum(x * x) FILTER (WHERE x{j} IS NOT NULL)", "p": "sum(x * x{j})"}
    frames = []
    for block in chunks(range(len(columns)), COLUMNS_PER_BLOCK):
        met = values.selectExpr(*[f"x{j}" for j in block], f"inline(array({each}))").filter("x IS NOT NULL")
        summed = met.groupBy("i").agg(*[F.expr(sql.format(j=j)).alias(f"{label}{j}") for j in block for label, sql in sums.items()])
        rows = ", ".join(f"named_struct('j', {j}, " + ", ".join(f"'{label}', {label}{j}" for label in sums) + ")" for j in block)
        frames.append(summed.selectExpr("i", f"inline(array({rows}))"))
    found = union_all(frames).filter("i <> j")
    first, second = F.col("i") < F.col("j"), F.col("i") > F.col("j")
    both = found.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(
        F.max("n").cast("double").alias("n"), F.max("p").alias("p"),
        *[F.max(F.when(test, F.col(c))).alias(f"{c}{k}") for k, test in ((1, first), (2, second)) for c in ("s", "q")],
    )
    spread_of = lambda k: F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n")
    # What is left of a constant column is rounding.
    flat = (spread_of(1) <= F.col("q1") * 1e-13) | (spread_of(2) <= F.col("q2") * 1e-13)
    r = F.when(F.col("n") > 1, F.when(flat, F.lit(float("nan"))).otherwise((F.col("p") - F.col("s1") * F.col("s2") / F.col("n")) / F.sqrt(spread_of(1) * spread_of(2))))
    names = F.array(*[F.lit(c) for c in columns])
    # Pairs that no row has are there too, without a correlation.
    pairs = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(len(columns)), 2)]))
    )
    return pairs.join(both.withColumn("correlation", r), ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "correlation"
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin (the last bin includes the maximum); empty bins are left out.

    A column of one value is given a range of one around it. Infinite values are outside every bin.
    """
    number = present(df, column).cast("double")
    value = F.when(F.abs(number) < F.lit(float("inf")), number)
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, lower double, upper double, rows bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((value - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1).cast("long"))
    return (
        df.filter(value.isNotNull())
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
            (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
            "rows",
        )
    )


def column_scores_sorted(df: DataFrame, n: int = 10) -> DataFrame:
    """The n best column scores, in ascending order."""
    best = column_scores(df).orderBy(F.col("score").desc(), F.col("column").desc()).limit(n)
    return best.orderBy("score", "column")


def missing_by_group(metrics: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """(group, field, missing_pct) from a wide frame of percentages."""
    return metrics.unpivot([group], list(fields), "field", "missing_pct")


def missing_matrix(metrics: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """One row per field and one column per group: the grouped-bar layout.

    The groups become columns, so they are read first; `metrics` is a small result frame.
    """
    return missing_by_group(metrics, group, fields).groupBy("field").pivot(group).agg(F.first("missing_pct"))
