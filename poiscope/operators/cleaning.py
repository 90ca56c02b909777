"""Cleaning steps and their change log.

A step is a small description; `clean` folds the steps into one lazy frame. What a step changes
is counted by plain aggregates on narrow flags that the fold carries along: consecutive steps
that change values in place share one column-pruned scan. The counts are ordinary query results,
so a task that runs twice after a lost executor does not count twice, as an accumulator would.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from poiscope.functions.exprs import FLOATING_TYPES, NUMERIC_TYPES, col, comparable_columns, missing, nested_as_text, present, quoted
from poiscope.operators.issues import outlier_bounds
from poiscope.operators.profile import analyze, duplicate_rows
from poiscope.plans.longform import spread, union_all
from poiscope.plans.ordering import fill_along, with_index
from poiscope.plans.quantiles import exact_quantiles

# Bytes of a dictionary that is sent to every task; a larger one is joined by a shuffle, with its hot values spread.
SENT_BYTES = 8 << 20
# A value is hot if it holds more than this share of the rows, so hot values are few whatever the table.
HOT_SHARE = 1 / 256
SPREAD = 256


@dataclass(frozen=True)
class FillMissing:
    """Fill the missing values of a column.

    method: constant, mean, median, mode, forward_fill or backward_fill; the last two need
    `order_by` (unique, not NULL) and may stay within `partition_by`.
    """

    column: str
    value: Any = None
    method: str = "constant"
    order_by: Sequence[str] = ()
    partition_by: Sequence[str] = ()


@dataclass(frozen=True)
class RemoveDuplicates:
    """Keep one row of each group that agrees on `columns` (default: all).

    With a subset of columns, `order_by` says which row is first and which is last.
    """

    columns: Sequence[str] | None = None
    keep: str = "first"
    order_by: Sequence[str] = ()


@dataclass(frozen=True)
class ConvertType:
    """Convert a column to date, numeric or categorical; values that do not convert become NULL.

    Categorical adds `<column>_code`, the 0-based place of the value among the sorted values.
    """

    column: str
    target_type: str


@dataclass(frozen=True)
class HandleOutliers:
    """Cap values at the quartile fences, or remove the rows beyond them."""

    column: str
    method: str = "cap"


@dataclass(frozen=True)
class StandardizeValues:
    """Replace values of a column by a mapping."""

    column: str
    mapping: Mapping[Any, Any] = field(default_factory=dict)


Step = FillMissing | RemoveDuplicates | ConvertType | HandleOutliers | StandardizeValues


@dataclass
class _Fold:
    """The frame so far with flag columns, and what to log about it."""

    df: DataFrame
    flags: dict[int, list[str]] = field(default_factory=dict)
    labels: dict[int, tuple[str, str | None, dict[str, Any]]] = field(default_factory=dict)
    logs: list[DataFrame] = field(default_factory=list)
    steps: int = 0

    @property
    def plain(self) -> DataFrame:
        return self.df.drop(*[f for names in self.flags.values() for f in names])

    def note(self, step: str, column: str | None, params: dict[str, Any]) -> int:
        self.steps += 1
        self.labels[self.steps] = (step, column, params)
        return self.steps

    def flag(self, number: int, *tests: Column) -> None:
        """Carry tests (rows affected, values lost) about the frame as it is now."""
        names = [f"_step{number}_{i}" for i in range(len(tests))]
        self.df = self.df.withColumns(dict(zip(names, tests)))
        self.flags[number] = names

    def _label(self, number: int) -> list[Column]:
        step, column, params = self.labels[number]
        said = json.dumps(params, sort_keys=True, default=str)
        return [F.lit(number), F.lit(step), F.lit(column).cast("string"), F.lit(said)]

    def settle(self) -> None:
        """Count the flags carried so far; called before rows leave the frame and at the end."""
        if not self.flags:
            return
        counts = [F.count_if(F.col(f)).alias(f) for names in self.flags.values() for f in names]
        rows = [
            (*self._label(n), F.col(names[0]), F.col(names[1]) if len(names) > 1 else F.lit(None).cast("bigint"))
            for n, names in self.flags.items()
        ]
        self.logs.append(spread(self.df.agg(*counts), LOG_FIELDS, rows))
        self.df = self.plain
        self.flags = {}

    def log_removed(self, number: int, one_row: DataFrame, removed: Column) -> None:
        self.logs.append(spread(one_row, LOG_FIELDS, [(*self._label(number), removed, F.lit(None).cast("bigint"))]))


LOG_FIELDS = ("step_no", "step", "column", "params", "rows_affected", "newly_null")


@dataclass
class Cleaned:
    """The cleaned frame and the log of what each step changed, both lazy."""

    frame: DataFrame
    _logs: list[DataFrame]

    def change_log(self) -> DataFrame:
        """(step_no, step, column, params, rows_affected, newly_null), one row per step that applied."""
        if not self._logs:
            schema = "step_no int, step string, `column` string, params string, rows_affected bigint, newly_null bigint"
            return self.frame.sparkSession.createDataFrame([], schema)
        return union_all(self._logs)


def clean(df: DataFrame, steps: Sequence[Step]) -> Cleaned:
    """Apply the steps in order."""
    fold = _Fold(df)
    for step in steps:
        _APPLY[type(step)](fold, step)
    fold.settle()
    return Cleaned(fold.df, fold.logs)


def basic_clean(df: DataFrame) -> Cleaned:
    """Unknown for missing addresses, then no duplicate rows."""
    return clean(df, [FillMissing("address", "Unknown"), RemoveDuplicates()])


# --- steps -----------------------------------------------------------------------------------


def _constant(df: DataFrame, name: str, value: Any) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, NUMERIC_TYPES):
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"cannot fill {kind.simpleString()} column {name} with {value!r}") from None
        if not isinstance(kind, (*FLOATING_TYPES, T.DecimalType)) and not number.is_integer():
            raise ValueError(f"cannot fill {kind.simpleString()} column {name} with {value!r}")
    return F.lit(value).cast(kind)


def most_frequent(df: DataFrame, name: str) -> Any:
    """Most frequent value, the lowest among equals; counted by a grouped shuffle, not in one buffer."""
    value = present(df, name)
    row = (
        df.filter(value.isNotNull())
        .groupBy(value.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "v")
        .first()
    )
    return row["v"] if row else None


def _fill_value(df: DataFrame, step: FillMissing) -> Any:
    name = step.column
    if step.method == "mean":
        return df.agg(F.avg(present(df, name)).alias("v")).first()["v"]
    if step.method == "median":
        return exact_quantiles(df, [name], [0.5])[name][0]
    if step.method == "mode":
        return most_frequent(df, name)
    raise ValueError(f"unknown fill method {step.method!r}")


def _fill(fold: _Fold, step: FillMissing) -> None:
    name, method, df = step.column, step.method, fold.df
    if method in ("forward_fill", "backward_fill"):
        if not step.order_by:
            raise ValueError(f"{method} needs order_by")
        number = fold.note("Fill Missing Values", name, {"method": method})
        marked = df.withColumn("_was_missing", missing(df, name)).withColumn(name, present(df, name))
        fold.df = fill_along(marked, name, step.order_by, step.partition_by, backward=method == "backward_fill")
        fold.flag(number, F.col("_was_missing") & col(name).isNotNull())
        fold.df = fold.df.drop("_was_missing")
        return
    if method == "constant":
        if step.value is None:
            return
        value, said = _constant(df, name, step.value), str(step.value)
    else:
        said = _fill_value(fold.plain, step)
        value = F.lit(said)
    number = fold.note("Fill Missing Values", name, {"method": method, "value": said})
    fold.flag(number, missing(df, name) if said is not None else F.lit(False))
    fold.df = fold.df.withColumn(name, F.coalesce(present(df, name), value))


def _deduplicate(fold: _Fold, step: RemoveDuplicates) -> None:
    fold.settle()
    df = fold.df
    names = list(step.columns) if step.columns else None
    if names is None or set(names) == set(df.columns):
        number = fold.note("Remove Duplicates", None, {})
        fold.log_removed(number, duplicate_rows(df), F.col("duplicate_count"))
        fold.df = _distinct_rows(df)
        return
    if step.keep not in ("first", "last"):
        raise ValueError(f"keep is first or last, not {step.keep!r}")
    if not step.order_by:
        raise ValueError("removing duplicates by some columns needs order_by")
    number = fold.note("Remove Duplicates", None, {"columns": names, "keep": step.keep})
    groups = df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("copies"))
    fold.log_removed(number, groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("removed")), F.col("removed"))

    def direction(c: Column) -> Column:
        return c.asc_nulls_last() if step.keep == "first" else c.desc_nulls_first()

    # Rank 1 is cut before and after the shuffle, so a hot group arrives as one row per task.
    place = F.row_number().over(W.partitionBy(*[col(c) for c in names]).orderBy(*[direction(col(o)) for o in step.order_by]))
    fold.df = df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def _distinct_rows(df: DataFrame) -> DataFrame:
    """One of each group of equal rows; maps and variants, which cannot be grouped on, by their text."""
    opaque = [f for f in df.schema.fields if isinstance(f.dataType, (T.MapType, T.VariantType))]
    if not opaque:
        return df.dropDuplicates()
    texts = {f"_text_{i}": nested_as_text(f) for i, f in enumerate(opaque)}
    keys = [c for c in df.columns if c not in {f.name for f in opaque}]
    return df.withColumns(texts).dropDuplicates([*keys, *texts]).drop(*texts)


def _convert(fold: _Fold, step: ConvertType) -> None:
    name, df = step.column, fold.df
    params = {"target_type": step.target_type}
    if step.target_type == "categorical":
        fold.flag(fold.note("Convert Data Type", name, params), F.lit(True))
        fold.df = with_codes(fold.df, name, fold.plain)
        return
    if step.target_type == "date":
        converted = F.coalesce(*_date_readings(df, name))
    elif step.target_type == "numeric":
        converted = F.expr(f"try_cast({quoted(name)} AS DOUBLE)")
    else:
        raise ValueError(f"unknown target type {step.target_type!r}")
    fold.flag(fold.note("Convert Data Type", name, params), F.lit(True), col(name).isNotNull() & converted.isNull())
    fold.df = fold.df.withColumn(name, converted)


def with_codes(df: DataFrame, name: str, source: DataFrame | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Adds `<name>_code`, the 0-based place of a value among the sorted values; no code for a missing one.

    The dictionary of values is sent to the tasks if its counted bytes allow it. Else it is joined by a shuffle, to
    which rows of a hot value, and rows without one, go under many keys.
    """
    value, source = present(df, name), source if source is not None else df
    counts = source.groupBy(present(source, name).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    size = F.sum(F.octet_length(F.col("_value").cast("string")) + 16)
    total = counts.agg(F.sum("_rows").alias("rows"), size.alias("bytes")).first()
    codes = with_index(counts.filter(F.col("_value").isNotNull()).select("_value"), ["_value"], "_code")
    if (total["bytes"] or 0) <= sent_bytes:
        joined = df.join(F.broadcast(codes), value == F.col("_value"), "left")
        return joined.withColumn(f"{name}_code", F.col("_code")).drop("_value", "_code")
    hot = counts.filter((F.col("_rows") > total["rows"] * HOT_SHARE) & F.col("_value").isNotNull()).select("_value")
    hot_values = [r["_value"] for r in hot.collect()]  # at most 1 / HOT_SHARE of them
    spread_out = lambda v: v.isNull() | (v.isin(hot_values) if hot_values else F.lit(False))
    turn = F.pmod(F.xxhash64(*map(col, comparable_columns(df))), F.lit(SPREAD)).cast("int")
    keyed = df.withColumn("_turn", F.when(spread_out(value), turn).otherwise(0))
    turns = F.when(spread_out(F.col("_value")), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    entries = codes.withColumn("_in", F.explode(turns))
    joined = keyed.join(entries, (value == F.col("_value")) & (F.col("_turn") == F.col("_in")), "left")
    return joined.withColumn(f"{name}_code", F.col("_code")).drop("_value", "_code", "_turn", "_in")


def _date_readings(df: DataFrame, name: str) -> list[Column]:
    """ISO dates and times as they are, then month/day/year."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return [F.expr(f"try_cast({quoted(name)} AS TIMESTAMP)")]
    c = quoted(name)
    return [
        F.when(col(name).rlike("^[0-9]{4}-"), F.expr(f"try_to_timestamp({c})")),
        F.expr(f"try_to_timestamp({c}, 'M/d/yyyy')"),
    ]


def _outliers(fold: _Fold, step: HandleOutliers) -> None:
    name, df = step.column, fold.df
    bounds = outlier_bounds(fold.plain, [name]).get(name) if step.method in ("cap", "remove") else None
    if bounds is None:
        return
    low, high = bounds[2], bounds[3]
    value = present(df, name)
    under, over = value < F.lit(low), value > F.lit(high)
    beyond = F.coalesce(under | over, F.lit(False))
    label = "Cap Outliers" if step.method == "cap" else "Remove Outliers"
    fold.flag(fold.note(label, name, {"lower_bound": low, "upper_bound": high}), beyond)
    if step.method == "remove":
        fold.settle()
        fold.df = fold.df.filter(~beyond)
    else:
        fold.df = fold.df.withColumn(name, F.when(under, F.lit(low)).when(over, F.lit(high)).otherwise(col(name)))


def _mapped_type(kind: T.DataType, targets: Sequence[Any]) -> T.DataType:
    """Type of a column of which some values become the targets: one that holds both, else text."""
    given = {type(v) for v in targets if v is not None}
    if not given:
        return kind
    if isinstance(kind, T.BooleanType) and given == {bool}:
        return kind
    if isinstance(kind, NUMERIC_TYPES) and given <= {int, float, Decimal}:
        if isinstance(kind, (*FLOATING_TYPES, T.DecimalType)) and (given == {int} or isinstance(kind, T.DoubleType)):
            return kind
        return T.LongType() if given == {int} else T.DoubleType()
    if isinstance(kind, T.TimestampType | T.TimestampNTZType) and given == {datetime}:
        return kind
    if isinstance(kind, T.DateType) and given == {date}:
        return kind
    return T.StringType()


def _said(value: Any, kind: T.DataType) -> str | None:
    """Text of a Python value, as a cast to the type reads it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower() if not isinstance(kind, NUMERIC_TYPES) else str(int(value))
    if isinstance(value, float) and value.is_integer() and not isinstance(kind, (*FLOATING_TYPES, T.StringType)):
        return str(int(value))
    return str(value)


def _standardize(fold: _Fold, step: StandardizeValues) -> None:
    """Old values are read as the column's type (those it cannot hold match nothing); of equal ones the last counts."""
    name, mapping = step.column, dict(step.mapping)
    if not mapping:
        return
    number = fold.note("Standardize Values", name, {"mapping": {str(k): v for k, v in mapping.items()}})
    kind = fold.df.schema[name].dataType
    result = _mapped_type(kind, list(mapping.values()))
    said = [(i, _said(k, kind), _said(v, result)) for i, (k, v) in enumerate(mapping.items())]
    entries = fold.df.sparkSession.createDataFrame(said, "_at int, _old string, _new string")
    old = F.col("_old").try_cast(kind)
    entries = entries.filter(old.isNotNull()).groupBy(old.alias("_old")).agg(F.max_by("_new", "_at").alias("_new"), F.lit(True).alias("_hit"))
    if sum(len(k or "") + len(v or "") + 16 for _, k, v in said) <= SENT_BYTES:
        entries = F.broadcast(entries)
    fold.df = fold.df.join(entries, col(name) == F.col("_old"), "left")
    fold.flag(number, F.col("_hit").isNotNull())
    new = F.when(F.col("_hit"), F.col("_new").cast(result)).otherwise(col(name).cast(result))
    fold.df = fold.df.withColumn(name, new).drop("_old", "_new", "_hit")


_APPLY = {
    FillMissing: _fill,
    RemoveDuplicates: _deduplicate,
    ConvertType: _convert,
    HandleOutliers: _outliers,
    StandardizeValues: _standardize,
}


# --- names and comparison --------------------------------------------------------------------


def standard_names(columns: Sequence[str]) -> list[str]:
    """Lower case, runs of other characters as one underscore, none at the ends; repeats get _2, _3, ..."""
    taken: set[str] = set()
    result = []
    for name in columns:
        base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "column"
        candidate, n = base, 2
        while candidate in taken:
            candidate, n = f"{base}_{n}", n + 1
        taken.add(candidate)
        result.append(candidate)
    return result


def standardize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


COMPARED = ("missing_values", "duplicate_rows", "scores", "location_data")


def before_after(before: DataFrame, after: DataFrame, sections: Sequence[str] = COMPARED) -> DataFrame:
    """Numeric profile metrics of two frames side by side; only the sections compared are computed."""

    def numbers(df: DataFrame, label: str) -> DataFrame:
        kept = analyze(df, sections=sections).filter(F.col("value").isNotNull())
        return kept.select("section", F.coalesce("column", F.lit("")).alias("column"), "metric", F.col("value").alias(label))

    keys = ["section", "column", "metric"]
    return (
        numbers(before, "before").join(numbers(after, "after"), keys, "full_outer")
        .withColumn("change", F.col("after") - F.col("before"))
    )
