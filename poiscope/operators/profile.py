"""Table profile: missing values, duplicates, coordinates, names, addresses, phones, dates, scores.

All counters of a table go through one scan; duplicates and name repeats take one shuffle each.
Percentages are rounded half-even to two places and are NULL on an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from poiscope.functions import roles
from poiscope.functions.exprs import (
    NESTED_TYPES,
    TEMPORAL_TYPES,
    col,
    comparable_columns,
    missing,
    missing_sql,
    percent,
    percent2,
    quoted,
    rounded,
    row_fingerprint,
    text_columns,
    text_literal,
)
from poiscope.plans.distincts import distinct_hashes, nearly_unique
from poiscope.plans.leading import leading_values
from poiscope.plans.longform import per_column, per_text_column, spread, tally, union_all

# Limits, patterns and date formats of the profile rules.
SHORT_ADDRESS = 10
PHONE_PATTERN = r"^\+?[0-9\-\(\)\s]{7,20}$"
DATE_FORMATS = {
    "yyyy-M-d": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "M/d/yyyy": "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "d/M/yyyy": "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
}
UNPARSED_LIMIT = 0.5
REPORTED_MISSING_PCT = 5
CRITICAL_MISSING_PCT = 20
VALID_COORDINATES_PCT = 90
REQUIRED_COLUMNS = ("id", "name")


# --- whole table -----------------------------------------------------------------------------


def basic_stats(df: DataFrame) -> DataFrame:
    """Each column with its type, and the size of the table."""
    rows = [(F.lit(name), F.lit(i), F.lit(kind)) for i, (name, kind) in enumerate(df.dtypes)]
    one = df.agg(F.count(F.lit(1)).alias("row_count"))
    rows = [(*r, F.col("row_count"), F.lit(len(df.columns))) for r in rows]
    return spread(one, ("column", "position", "type", "row_count", "column_count"), rows)


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage of each column."""
    return per_column(df, columns or df.columns, {"missing_count": lambda c: f"count_if({missing_sql(df, c)})"}).withColumn(
        "missing_pct", percent2(F.col("missing_count"), F.col("row_count"))
    )


def overall_missing(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table."""
    cells = F.max("row_count") * F.count(F.lit(1))
    return missing_values(df).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("missing_count").alias("missing_cells"),
        percent2(F.sum("missing_count"), cells).alias("overall_missing_pct"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows.

    Groups on the 16-byte identity of the row, so the shuffle carries that and a count instead of
    whole rows; copies are combined before the shuffle however many there are.
    """
    identity = df.select(*row_fingerprint(df))
    groups = identity.groupBy(*identity.columns).agg(F.count(F.lit(1)).alias("copies"))
    total, extra = F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return groups.agg(total.alias("row_count"), extra.alias("duplicate_count")).withColumn(
        "duplicate_pct", percent2(F.col("duplicate_count"), F.col("row_count"))
    )


def column_overview(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Type, missing share and the first three values of each column, in the given row order."""
    columns = df.columns
    types = F.create_map(*[x for name, kind in df.dtypes for x in (F.lit(name), F.lit(kind))])
    samples = leading_values(df, columns, order_by, 3)
    return (
        missing_values(df, columns)
        .join(samples, "column", "left")
        .select("column", "position", types[F.col("column")].alias("type"), "missing_pct", F.col("samples").alias("sample_values"))
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, worst first; critical above 20 %."""
    return (
        missing_values(df)
        .filter(F.col("missing_count") > 0)
        .select("column", "missing_count", "missing_pct", (F.col("missing_pct") > CRITICAL_MISSING_PCT).alias("critical"))
        .orderBy(F.col("missing_pct").desc(), "column")
    )


def validation_summary(df: DataFrame) -> DataFrame:
    """One row: size, share of missing cells, duplicates and the problems they amount to."""
    cells = missing_values(df).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        percent2(F.sum("missing_count"), F.max("row_count") * F.count(F.lit(1))).alias("null_percentage"),
        F.count_if(F.col("missing_pct") > REPORTED_MISSING_PCT).alias("problem_columns"),
    )
    copies = duplicate_rows(df).select("row_count", "duplicate_count", "duplicate_pct")
    both = cells.join(copies, "row_count")  # one row each
    return both.withColumn(
        "potential_issues",
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(F.col("row_count") == 0, F.lit("table is empty")),
                    F.when(F.col("problem_columns") > 0, F.concat(F.col("problem_columns").cast("string"), F.lit(" columns above 5% missing"))),
                    F.when(F.col("duplicate_count") > 0, F.concat(F.col("duplicate_count").cast("string"), F.lit(" duplicate rows"))),
                )
            ),
            "; ",
        ),
    )


def problem_columns(df: DataFrame) -> DataFrame:
    """Columns above 5 % missing, worst first."""
    return (
        missing_values(df)
        .filter(F.col("missing_pct") > REPORTED_MISSING_PCT)
        .select("column", "missing_pct")
        .orderBy(F.col("missing_pct").desc(), "column")
    )


def validate_table(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row per failed check; no rows means the table is valid. An empty table fails only that check."""
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    filled = per_column(numbered, numbered.columns, {"missing_count": lambda c: f"count_if({missing_sql(numbered, c)})"})
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)
    all_null = (F.col("missing_count") == F.col("row_count")) & (F.col("row_count") > 0)
    verdict = filled.agg(
        F.max("row_count").alias("row_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(all_null, F.struct(F.col("position"), label.alias("name"))))),
                lambda s: s["name"],
            ),
            ", ",
        ).alias("empty_columns"),
    )
    absent = [r for r in required if r not in names]
    checks = [
        (F.lit(1), F.when(F.col("row_count") == 0, F.lit("Table is empty"))),
        (F.lit(2), F.when(F.lit(bool(absent)) & (F.col("row_count") > 0), F.lit("Missing required columns: " + ", ".join(absent)))),
        (F.lit(3), F.when(F.col("empty_columns") != "", F.concat(F.lit("Columns with all null values: "), F.col("empty_columns")))),
        (F.lit(4), F.when(F.lit(len(set(names)) < len(names)) & (F.col("row_count") > 0), F.lit("Duplicate column names"))),
    ]
    return spread(verdict, ("check_no", "issue"), checks).filter(F.col("issue").isNotNull())


def size_profile(df: DataFrame) -> DataFrame:
    """Bytes of data per column and their share: text by its length, the rest by type width."""
    widths = {
        T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
        T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
    }

    def size(c: str) -> str:
        kind, name = df.schema[c].dataType, quoted(c)
        if type(kind) in widths:
            return f"count({name}) * {widths[type(kind)]}"
        value = f"CASE WHEN {name} IS NOT NULL THEN to_json(struct({name})) END" if isinstance(kind, NESTED_TYPES) else name
        return f"coalesce(sum(CAST(octet_length({value}) AS BIGINT)), 0)"

    per = per_column(df, df.columns, {"bytes": size})
    total = per.agg(F.sum("bytes").alias("total")).scalar()
    return per.select("column", "position", "bytes", rounded(percent(F.col("bytes"), total), 6).alias("percent"))


def key_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns whose values are all present and all different.

    A sketch rules out columns that have fewer than 80 % as many values as rows by its estimate, which is 12 standard
    errors off the mark; the rest are counted exactly, on hashes of fixed width.
    """
    rows = df.count()
    return telling(df, nearly_unique(df, list(columns or comparable_columns(df)), rows), rows, rows)


def distinct_row_keys(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that would be keys if every row were kept once: `key_candidates` of the distinct rows.

    Nothing is deduplicated: a column without missing values tells the distinct rows apart exactly when it has as
    many distinct values as there are distinct rows.
    """
    counted = duplicate_rows(df).first()
    once = counted["row_count"] - counted["duplicate_count"]
    return telling(df, nearly_unique(df, list(columns or comparable_columns(df)), once), counted["row_count"], once)


def telling(df: DataFrame, columns: Sequence[str], rows: int, distinct_rows: int) -> DataFrame:
    """(column, distinct_count) of the columns that have a value in each of the rows and tell the distinct rows apart."""
    found = distinct_hashes(df, columns).filter((F.col("distinct_count") == distinct_rows) & (F.col("non_null_count") == rows))
    return found.select("column", "distinct_count")


# What a piece of text looks like, tried in this order; anything else is text.
VALUE_CLASSES = {
    "number": r"^[+-]?[0-9]+([.][0-9]+)?$",
    "date": r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$",
    "boolean": r"^([Tt]rue|[Ff]alse|TRUE|FALSE)$",
}


def mixed_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many values of each text column look like numbers, dates, booleans and text."""

    def of_class(pattern: str):
        return lambda v: F.count_if(v.rlike(pattern))

    terms = {f"{label}_count": of_class(pattern) for label, pattern in VALUE_CLASSES.items()}
    terms["value_count"] = lambda v: F.count(F.nullif(v, F.lit("")))
    counted = per_text_column(df, list(columns or text_columns(df)), terms)
    known = [f"{label}_count" for label in VALUE_CLASSES]
    text_count = F.col("value_count") - sum((F.col(k) for k in known), F.lit(0))
    with_text = counted.withColumn("text_count", text_count)
    present_classes = F.array_compact(
        F.array(*[F.when(F.col(f"{k}_count") > 0, F.lit(k)) for k in (*VALUE_CLASSES, "text")])
    )
    return (
        with_text.withColumn("_classes", present_classes)
        .withColumn("classes", F.array_join("_classes", ", "))
        .withColumn("mixed", F.size("_classes") > 1)
        .select("column", "position", *known, "text_count", "classes", "mixed")
    )


# --- columns found by role -------------------------------------------------------------------


def _required_role(df: DataFrame, role: str, given: str | None) -> str:
    found = given or roles.first(df.columns, role)
    if not found:
        raise ValueError(f"no {role} column among {df.columns}")
    return found


def _valid_coordinates(lat: str, lon: str) -> Column:
    return col(lat).between(-90, 90) & col(lon).between(-180, 180)


def coordinate_validity(df: DataFrame, latitude: str | None = None, longitude: str | None = None) -> DataFrame:
    """Rows with both coordinates in range, rows without, and rows lacking one."""
    lat, lon = _required_role(df, "latitude", latitude), _required_role(df, "longitude", longitude)
    one = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(_valid_coordinates(lat, lon)).alias("valid_count"),
        F.count_if(missing(df, lat) | missing(df, lon)).alias("null_count"),
    ).withColumn("invalid_count", F.col("row_count") - F.col("valid_count"))
    return one.select(
        "row_count",
        *[x for k in ("valid", "invalid", "null") for x in (F.col(f"{k}_count"), percent2(F.col(f"{k}_count"), F.col("row_count")).alias(f"{k}_pct"))],
    )


def valid_coordinates_flag(df: DataFrame, latitude: str | None = None, longitude: str | None = None) -> DataFrame:
    """Valid coordinates with a warning below 90 %."""
    share = percent(F.col("valid_count"), F.col("row_count"))
    return coordinate_validity(df, latitude, longitude).select(
        "valid_count", rounded(share, 6).alias("valid_pct"), (share < VALID_COORDINATES_PCT).alias("warning")
    )


def name_quality(df: DataFrame, name: str | None = None) -> DataFrame:
    """Missing names, and rows that repeat an earlier name (repeats of a missing name included)."""
    name = _required_role(df, "business_name", name)
    groups = df.groupBy(col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    one = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("name").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    )
    return one.select(
        "row_count",
        "missing_count", percent2(F.col("missing_count"), F.col("row_count")).alias("missing_pct"),
        "duplicate_count", percent2(F.col("duplicate_count"), F.col("row_count")).alias("duplicate_pct"),
    )


def category_distribution(df: DataFrame, category: str | None = None) -> DataFrame:
    """Rows per category, most frequent first."""
    category = _required_role(df, "category", category)
    return (
        df.filter(col(category).isNotNull())
        .groupBy(col(category).cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("location_count"))
        .orderBy(F.col("location_count").desc(), "category")
    )


def _missing_and(df: DataFrame, column: str, label: str, test: Column) -> DataFrame:
    one = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(missing(df, column)).alias("missing_count"),
        F.count_if(test).alias(f"{label}_count"),
    )
    return one.select(
        "row_count",
        "missing_count", percent2(F.col("missing_count"), F.col("row_count")).alias("missing_pct"),
        f"{label}_count", percent2(F.col(f"{label}_count"), F.col("row_count")).alias(f"{label}_pct"),
    )


def address_quality(df: DataFrame, address: str | None = None) -> DataFrame:
    """Missing addresses and addresses shorter than ten characters."""
    address = _required_role(df, "address", address)
    return _missing_and(df, address, "incomplete", F.length(col(address)) < SHORT_ADDRESS)


def phone_quality(df: DataFrame, phone: str | None = None) -> DataFrame:
    """Missing phone numbers and phone numbers of an unlikely form."""
    phone = _required_role(df, "phone", phone)
    return _missing_and(df, phone, "invalid", ~col(phone).rlike(PHONE_PATTERN))


def _readings(text: Column) -> dict[str, Column]:
    """Text read as a timestamp by each format, and at last freely."""
    # The shape is tested first: a failing parse is far dearer than a failing match.
    read = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in DATE_FORMATS.items()]
    read.append(F.when(text.rlike("^[0-9]{4}-"), F.try_to_timestamp(text)))
    return {f"t{j}": r.cast("timestamp_ntz") for j, r in enumerate(read)}


def _text_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    last = len(DATE_FORMATS)
    derived = {f"t{j}": lambda v, j=j: _readings(v)[f"t{j}"] for j in range(last + 1)}
    terms = {"filled": F.count}
    for j in range(last + 1):
        terms |= {
            f"n{j}": lambda v, j=j: F.count(f"t{j}"),
            f"lo{j}": lambda v, j=j: F.min(f"t{j}"),
            f"hi{j}": lambda v, j=j: F.max(f"t{j}"),
        }

    def chosen(kind: str) -> Column:
        pick = F.col(f"{kind}{last}")
        for j in reversed(range(last)):
            unread = F.try_divide((F.col("row_count") - F.col(f"n{j}")).cast("double"), F.col("row_count").cast("double"))
            pick = F.when(unread <= UNPARSED_LIMIT, F.col(f"{kind}{j}")).otherwise(pick)
        return pick

    return per_text_column(df, columns, terms, derived).select(
        "column", "row_count", (F.col("row_count") - F.col("filled")).alias("missing_count"),
        chosen("n").alias("parsed_count"), chosen("lo").alias("lo"), chosen("hi").alias("hi"),
    )


def _real_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    terms = {
        "missing_count": lambda c: f"count_if({quoted(c)} IS NULL)",
        "parsed_count": lambda c: f"count({quoted(c)})",
        "lo": lambda c: f"CAST(min({quoted(c)}) AS TIMESTAMP_NTZ)",
        "hi": lambda c: f"CAST(max({quoted(c)}) AS TIMESTAMP_NTZ)",
    }
    return per_column(df, columns, terms).drop("position")


def temporal_columns_of(df: DataFrame, overrides: Mapping[str, list[str]] | None = None) -> list[str]:
    """Date, timestamp and text columns of temporal name."""
    kinds = (*TEMPORAL_TYPES, T.StringType)
    return [c for c in roles.resolve(df.columns, "temporal", overrides) if isinstance(df.schema[c].dataType, kinds)]


def temporal_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values and date range of the temporal columns.

    Text is read by the first format that leaves at most half of all rows unread, or else
    freely. A time of day alone names no date.
    """
    columns = list(columns) if columns is not None else temporal_columns_of(df)
    if not columns:
        raise ValueError(f"no temporal column among {df.columns}")
    text = set(text_columns(df))
    kinds = [(_text_dates, [c for c in columns if c in text]), (_real_dates, [c for c in columns if c not in text])]
    return union_all([profile(df, cs) for profile, cs in kinds if cs]).select(
        "column",
        "missing_count",
        percent2(F.col("missing_count"), F.col("row_count")).alias("missing_pct"),
        "parsed_count",
        F.date_format("lo", "yyyy-MM-dd").alias("min_date"),
        F.date_format("hi", "yyyy-MM-dd").alias("max_date"),
        F.expr("timestampdiff(DAY, lo, hi)").cast("long").alias("range_days"),
        ((F.col("parsed_count") == 0) & (F.col("missing_count") < F.col("row_count"))).alias("format_issues"),
    )


# --- score and composition -------------------------------------------------------------------

# Role of a key field -> its section of the profile.
SCORED_ROLES = {"address": "addresses", "business_name": "business_names", "category": "categories", "phone": "phone_numbers"}


def _core_metrics(df: DataFrame, overrides: Mapping[str, list[str]] | None) -> DataFrame:
    """(section, column, metric, value) of everything that one scan can count, and of the duplicates."""
    names = df.columns
    lat, lon = roles.first(names, "latitude", overrides), roles.first(names, "longitude", overrides)
    address, phone = roles.first(names, "address", overrides), roles.first(names, "phone", overrides)
    entries = [(("missing_values", c, "missing"), missing_sql(df, c)) for c in names]
    for role, section in SCORED_ROLES.items():
        chosen = roles.first(names, role, overrides)
        if chosen:
            entries.append(((section, chosen, "missing"), missing_sql(df, chosen)))
    if lat and lon:
        valid = f"{quoted(lat)} BETWEEN -90 AND 90 AND {quoted(lon)} BETWEEN -180 AND 180"
        entries += [
            (("location_data", lat, "valid"), valid),
            (("location_data", lat, "invalid"), f"NOT coalesce({valid}, false)"),
            (("location_data", lat, "null"), f"{missing_sql(df, lat)} OR {missing_sql(df, lon)}"),
        ]
    if address and address in text_columns(df):
        entries.append((("addresses", address, "incomplete"), f"length({quoted(address)}) < {SHORT_ADDRESS}"))
    if phone and phone in text_columns(df):
        entries.append((("phone_numbers", phone, "invalid"), f"NOT {quoted(phone)} RLIKE {text_literal(PHONE_PATTERN)}"))
    counted = tally(df, ("section", "column", "metric"), entries)
    copies = duplicate_rows(df).select(
        F.lit("duplicate_rows").alias("section"), F.lit(None).cast("string").alias("column"), F.lit("duplicate").alias("metric"),
        F.col("duplicate_count").alias("n"), "row_count",
    )
    long = counted.unionByName(copies)
    return long.select(
        "section", "column",
        F.inline(
            F.array(
                F.struct(F.concat("metric", F.lit("_count")).alias("metric"), F.col("n").cast("double").alias("value")),
                F.struct(F.concat("metric", F.lit("_pct")).alias("metric"), percent2(F.col("n"), F.col("row_count")).alias("value")),
                F.struct(F.concat("metric", F.lit("_rows")).alias("metric"), F.col("row_count").cast("double").alias("value")),
            )
        ),
    )


def _scored(core: DataFrame) -> DataFrame:
    """One row: the metrics as an array `items`, and the scores made of them. The metrics are planned once."""
    items = F.col("items")

    def values(section: str, metric: str) -> Column:
        return F.transform(F.filter(items, lambda i: (i["section"] == section) & (i["metric"] == metric)), lambda i: i["value"])

    def one(section: str, metric: str) -> Column:
        return F.coalesce(F.array_max(values(section, metric)), F.lit(0.0))

    def total(metric: str) -> Column:
        return F.aggregate(values("missing_values", metric), F.lit(0.0), lambda x, y: x + y)

    overall = F.coalesce(percent2(total("missing_count"), total("missing_rows")), F.lit(0.0))
    fields = sum((one(s, "missing_pct") for s in SCORED_ROLES.values()), F.lit(0.0))
    parts = core.agg(F.collect_list(F.struct("section", "column", "metric", "value")).alias("items")).withColumns(
        {
            "overall_missing_pct": overall,
            "_duplicates": one("duplicate_rows", "duplicate_pct"),
            "_coordinates": one("location_data", "invalid_pct"),
            "_fields": fields / 10.0,
        }
    )
    penalty = (
        F.least(F.lit(30.0), F.col("overall_missing_pct") / 2)
        + F.least(F.lit(20.0), F.col("_duplicates") * 2)
        + F.least(F.lit(15.0), F.col("_coordinates") / 2)
        + F.least(F.lit(25.0), F.col("_fields"))
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - penalty))
    return parts.select(
        "items",
        F.bround(score, 1).alias("quality_score"),
        F.bround(F.lit(100.0) - F.col("overall_missing_pct"), 1).alias("completeness"),
        "overall_missing_pct",
    )


def quality_score(df: DataFrame, overrides: Mapping[str, list[str]] | None = None) -> DataFrame:
    """100 minus bounded penalties for missing cells, duplicates, coordinates and key fields."""
    return _scored(_core_metrics(df, overrides)).select("quality_score", "completeness")


def analyze(
    df: DataFrame, overrides: Mapping[str, list[str]] | None = None, sections: Sequence[str] | None = None
) -> DataFrame:
    """The whole profile as (section, column, metric, value, text), or some of its sections.

    What only other sections need is not computed.
    """
    wanted = lambda name: sections is None or name in sections
    none = F.lit(None).cast("string")
    frames = []
    later = ("basic", "business_names", "category_distribution", "temporal_data")
    if sections is None or set(sections) - set(later):
        told = F.transform(
            F.filter("items", lambda i: ~i["metric"].endswith("_rows")),
            lambda i: F.struct(i["section"].alias("section"), i["column"].alias("column"), i["metric"].alias("metric"), i["value"].alias("value")),
        )
        scores = [
            F.struct(F.lit("scores").alias("section"), none.alias("column"), F.lit(m).alias("metric"), F.col(m).alias("value"))
            for m in ("quality_score", "completeness", "overall_missing_pct")
        ]
        frames.append(_scored(_core_metrics(df, overrides)).select(F.inline(F.concat(told, F.array(*scores)))).withColumn("text", none))
    if wanted("basic"):
        kinds = [
            F.struct(
                F.lit("basic").alias("section"), F.lit(name).alias("column"), F.lit("column_type").alias("metric"),
                F.lit(float(i)).alias("value"), F.lit(kind).alias("text"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]
        frames.append(df.sparkSession.range(1).select(F.inline(F.array(*kinds))))
    name = roles.first(df.columns, "business_name", overrides)
    if name and wanted("business_names"):
        frames.append(
            spread(
                name_quality(df, name),
                ("section", "column", "metric", "value", "text"),
                [(F.lit("business_names"), F.lit(name), F.lit(m), F.col(m).cast("double"), none) for m in ("duplicate_count", "duplicate_pct")],
            )
        )
    category = roles.first(df.columns, "category", overrides)
    if category and wanted("category_distribution"):
        counts = category_distribution(df, category)
        frames.append(
            counts.select(
                F.lit("category_distribution").alias("section"), F.lit(category).alias("column"), F.lit("location_count").alias("metric"),
                F.col("location_count").cast("double").alias("value"), F.col("category").alias("text"),
            )
        )
    dates = temporal_columns_of(df, overrides)
    if dates and wanted("temporal_data"):
        profile = temporal_profile(df, dates)
        cells = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), none.alias("text")) for m in ("missing_count", "missing_pct", "range_days")],
            *[F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value"), F.col(m).alias("text")) for m in ("min_date", "max_date")],
        )
        frames.append(profile.select(F.lit("temporal_data").alias("section"), "column", F.inline(cells)))
    if not frames:
        return df.sparkSession.createDataFrame([], "section string, `column` string, metric string, value double, text string")
    found = union_all(frames)
    return found if sections is None else found.filter(F.col("section").isin(*sections))
