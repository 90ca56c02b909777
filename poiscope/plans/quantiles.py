"""Exact continuous percentiles by radix selection, without one task holding a whole column.

Spark's `percentile` keeps every distinct value of a column in the buffer of one task. Here values fall into
buckets by a digit that never falls as the value grows: first the sign and the binary logarithm in steps of 1/256,
later equal steps between the least and the greatest value of the bucket looked into. Buckets are counted for all columns by one grouped
aggregate, combined in the task, and the bucket that holds a wanted rank is found from the running counts. A bucket
with one value, or two, is an answer. One with few values is counted value by value next, any other by a further
digit. The least and the greatest value of a bucket have different digits, so every scan narrows the search. Two scans
answer for tables of some ten million rows, three for a million million.

All counts are exact and nothing is estimated: ties, hot values, infinities and extreme ranges need no special case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame, Window as W, functions as F

from poiscope.functions.exprs import chunks, present

#: Steps of a further digit, and values of a bucket that are counted one by one: both bound what one task orders.
DIGITS = 1 << 16
FEW = 1 << 16
COLUMNS_PER_SCAN = 50

# Steps of a binary logarithm lie between -1074 * 256 and 1024 * 256: the offset makes digits of positive numbers positive.
STEPS, _OFFSET, _INFINITE = 256, 300_000, 600_000
_SIZE = "CASE WHEN {0} = double('infinity') THEN %d ELSE %d + CAST(floor(log2({0}) * %dD) AS INT) END" % (_INFINITE, _OFFSET, STEPS)
FIRST_DIGIT = f"CASE WHEN v = 0D THEN 0 WHEN v > 0D THEN {_SIZE.format('v')} ELSE -({_SIZE.format('-v')}) END"


@dataclass
class _Bucket:
    """Values of a column from `low` to `high`, `inside` in number, and the ranks wanted, counted within the bucket."""

    column: int
    low: float
    high: float
    inside: int
    ranks: dict[int, tuple[int, int]]  # rank in the bucket -> (column, rank in the column)

    def digit(self, v: str, few: int, digits: int) -> str:
        """SQL of the next digit of `v`: the value itself where values are few."""
        if self.inside <= few:
            return v
        return f"floor(({v} - {_double(self.low)}) / ({_double(self.high)} - {_double(self.low)}) * {digits}D)"


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], few: int = FEW, digits: int = DIGITS
) -> dict[str, list[float | None]]:
    """Continuous (interpolated) percentiles per column; None for a column without values."""
    probs = [float(p) for p in probs]
    places = [f"{f}((total - 1) * {p!r}D)" for p in probs for f in ("floor", "ceil")]
    totals, buckets = _selected(df, columns, places, few, digits)
    answers = {place: b.low if rank == 0 else b.high for b in buckets for rank, place in b.ranks.items()}
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        at = [(totals[i] - 1) * p for p in probs] if i in totals else []
        result[c] = [_between(answers[i, floor(x)], answers[i, ceil(x)], x - floor(x)) for x in at] or [None] * len(probs)
    return result


def nth_smallest(df: DataFrame, column: str, n: int, few: int = FEW, digits: int = DIGITS) -> tuple[float, int, int] | None:
    """(the n-th smallest value, how many rows have it, how many of these are among the n smallest); None if there are no n."""
    _, buckets = _selected(df, [column], [f"{n - 1}L"], few, digits, ties=True)
    return next(((b.low, b.inside, rank + 1) for b in buckets for rank in b.ranks), None)


def _selected(
    df: DataFrame, columns: Sequence[str], places: Sequence[str], few: int, digits: int, ties: bool = False
) -> tuple[dict[int, int], list[_Bucket]]:
    """Number of values of each column, and the buckets that answer for its ranks: of one value, or (without `ties`) of two."""
    values = df.select(*[present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    totals: dict[int, int] = {}
    done: list[_Bucket] = []
    found: list[_Bucket] = []
    for c, total, buckets in _first(values, len(columns), places):
        totals[c] = total
        found += buckets
    while found:
        answered = [b for b in found if b.low == b.high or (b.inside <= 2 and not ties)]
        looked = [b for b in found if b not in answered]
        done += answered
        found = list(_next(values, looked, few, digits)) if looked else []
    return totals, done


def _between(a: float, b: float, weight: float) -> float:
    return a + 0.0 if a == b or not weight else a + (b - a) * weight


def _double(value: float) -> str:
    return f"double('{value!r}')"


def _counted(rows: DataFrame, wanted: str) -> DataFrame:
    """Of the buckets of (part, digit, v): those that hold a rank wanted, with the ranks, and how many values come before."""
    buckets = rows.groupBy("part", "digit").agg(
        F.count(F.lit(1)).alias("inside"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    part = W.partitionBy("part")
    return (
        buckets.withColumn("total", F.sum("inside").over(part))
        .withColumn("before", F.sum("inside").over(part.orderBy("digit")) - F.col("inside"))
        .withColumn("ranks", F.expr(f"filter({wanted}, r -> r >= before AND r < before + inside)"))
        .filter(F.size("ranks") > 0)
    )


def _first(values: DataFrame, columns: int, places: Sequence[str]) -> Iterator[tuple[int, int, list[_Bucket]]]:
    """(column, number of values, buckets) by sign and exponent; places are SQL of ranks, given `total` values."""
    for part in chunks(range(columns), COLUMNS_PER_SCAN):
        structs = ", ".join(f"named_struct('part', {i}, 'v', v{i})" for i in part)
        rows = values.selectExpr(f"inline(array({structs}))").filter("v IS NOT NULL").selectExpr("part", "v", f"{FIRST_DIGIT} AS digit")
        found: dict[int, tuple[int, list[_Bucket]]] = {}
        for r in _counted(rows, f"array_distinct(array({', '.join(places)}))").collect():
            ranks = {k - r["before"]: (r["part"], k) for k in r["ranks"]}
            found.setdefault(r["part"], (r["total"], []))[1].append(_Bucket(r["part"], r["low"], r["high"], r["inside"], ranks))
        yield from ((c, *rest) for c, rest in found.items())


def _next(values: DataFrame, looked: Sequence[_Bucket], few: int, digits: int) -> Iterator[_Bucket]:
    """The buckets within the buckets looked into that hold their ranks."""
    of_column: dict[int, list[int]] = {}
    for i, b in enumerate(looked):
        of_column.setdefault(b.column, []).append(i)
    for part in chunks(list(of_column), COLUMNS_PER_SCAN):
        structs, ranks, tests = [], [], []
        for c in part:
            cases = []
            for i in of_column[c]:
                b, v = looked[i], f"v{c}"
                tests.append(f"({v} >= {_double(b.low)} AND {v} <= {_double(b.high)})")
                cases.append(f"WHEN {tests[-1]} THEN named_struct('part', {i}, 'digit', CAST({b.digit(v, few, digits)} AS DOUBLE), 'v', {v})")
                ranks.append(f"{i}, array({', '.join(f'{k}L' for k in b.ranks)})")
            structs.append(f"CASE {' '.join(cases)} END")
        rows = values.filter(" OR ".join(tests)).selectExpr(f"inline(array({', '.join(structs)}))").filter("part IS NOT NULL")
        for r in _counted(rows, f"element_at(map({', '.join(ranks)}), part)").collect():
            b = looked[r["part"]]
            yield _Bucket(
                b.column, r["low"], r["high"], r["inside"], {k - r["before"]: b.ranks[k] for k in r["ranks"]}
            )
