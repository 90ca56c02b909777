"""Column expressions shared by the operators.

Percentages are DOUBLE and NULL on an empty table. `missing` follows the convention that a
floating-point NaN is as absent as a NULL. Empty strings are values, not missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The category names and the status that define the business filters.
RETAIL_CATEGORIES = ("retail", "convenience_and_grocery_stores")
DINING_CATEGORY = "dining"
OPEN_STATUS = "open"

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def quoted(name: str) -> str:
    """Backtick-quote a column name for use inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str | None) -> str:
    """SQL literal of a text, for expressions built as SQL."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col(quoted(name))


def is_retail() -> Column:
    return F.col("main_category").isin(*RETAIL_CATEGORIES)


def is_open() -> Column:
    return F.col("open_closed_status") == OPEN_STATUS


def has_chain() -> Column:
    return F.col("chain_id").isNotNull() & (F.col("chain_id") != "")


def open_retail(df: DataFrame) -> DataFrame:
    return df.filter(is_retail() & is_open())


def blank(name: str) -> Column:
    """NULL or empty text."""
    return col(name).isNull() | (col(name) == "")


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    if isinstance(df.schema[name].dataType, FLOATING_TYPES):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def missing_sql(df: DataFrame, name: str) -> str:
    """`missing` as SQL text."""
    c = quoted(name)
    return f"({c} IS NULL OR isnan({c}))" if isinstance(df.schema[name].dataType, FLOATING_TYPES) else f"({c} IS NULL)"


def present_sql(df: DataFrame, name: str) -> str:
    """`present` as SQL text."""
    c = quoted(name)
    return f"CASE WHEN NOT isnan({c}) THEN {c} END" if isinstance(df.schema[name].dataType, FLOATING_TYPES) else c


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into NULL."""
    if isinstance(df.schema[name].dataType, FLOATING_TYPES):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as DOUBLE, NULL when whole is zero."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def rounded(value: Column, places: int) -> Column:
    """Round half away from zero in binary arithmetic: scale, round to a whole number, scale back.

    Spark's own `round` goes through the decimal text of the number, which moves values such as
    0.285 (stored a little below) up where binary arithmetic keeps them down.
    """
    scale = F.lit(10.0**places)
    return F.round(value * scale, 0) / scale


def percent2(part: Column, whole: Column) -> Column:
    """Percentage rounded half-even to two places, the rounding of the profile metrics."""
    return F.bround(percent(part, whole), 2)


def distinct_list(name: str) -> Column:
    """Distinct non-NULL values of a text column, sorted and joined with ', '."""
    c = quoted(name)
    return F.expr(f"listagg(DISTINCT {c}, ', ') WITHIN GROUP (ORDER BY {c})")


def value_list(name: str) -> Column:
    """As distinct_list, for several lists in one aggregation; meant for already combined rows."""
    joined = F.array_join(F.array_sort(F.collect_set(col(name))), ", ")
    return F.when(F.count(col(name)) > 0, joined)


def hour_of(clock: Column) -> Column:
    """Hour of a time of day kept as 'HH:mm:ss' text."""
    return F.substring(clock, 1, 2).cast("int")


def first_by_sql(value: str, *order: str) -> str:
    """SQL for the non-NULL value of the row that comes first in the given order."""
    keys = ", ".join(quoted(o) for o in order)
    return f"min_by({value}, CASE WHEN {value} IS NOT NULL THEN struct({keys}) END)"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL_TYPES)]


def comparable_columns(df: DataFrame) -> list[str]:
    """Columns that can be grouped on as they are."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]


def chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def nested_as_text(field: T.StructField) -> Column:
    """JSON text of a nested value, with NULL fields kept and full time precision; map entries in the order of their keys."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"timestampFormat": stamp + "XXX", "timestampNTZFormat": stamp, "ignoreNullFields": "false"}
    return F.to_json(F.struct(_ordered(col(field.name), field.dataType).alias(field.name)), options)


def _ordered(value: Column, kind: T.DataType) -> Column:
    """The value with all maps in it as entries sorted by key."""
    if isinstance(kind, T.MapType):
        return F.array_sort(
            F.transform(
                F.map_entries(value),
                lambda e: F.struct(F.to_json(F.struct(_ordered(e["key"], kind.keyType))).alias("key"), _ordered(e["value"], kind.valueType).alias("value")),
            ),
            lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
        )
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(value, lambda e: _ordered(e, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        fields = [_ordered(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the whole row from different seeds: its 128-bit identity.

    The hash function skips NULLs, so which columns are NULL is hashed as bit masks beside the
    values. Among 10**12 different rows the chance of any two sharing both hashes is about 10**-15.
    """
    fields = df.schema.fields
    values = [nested_as_text(f) if isinstance(f.dataType, NESTED_TYPES) else col(f.name) for f in fields]
    masks = []
    for part in chunks(fields, 63):
        bits = [F.shiftleft(col(f.name).isNull().cast("long"), i) for i, f in enumerate(part)]
        masks.append(sum(bits[1:], bits[0]))
    return [F.xxhash64(F.lit(seed), *masks, *values).alias(f"row_id_{seed}") for seed in (1, 2)]
