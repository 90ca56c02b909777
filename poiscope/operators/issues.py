"""Issue detection: which columns and rows need attention, as (issue_type, column, detail, value).

Counters of one table share a scan. Checks on "the first value" of a column use the row order
given by the caller, since a table has none of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from poiscope.functions import roles
from poiscope.functions.exprs import (
    chunks,
    col,
    comparable_columns,
    first_by_sql,
    missing_sql,
    numeric_columns,
    percent2,
    present,
    present_sql,
    quoted,
    rounded,
    text_columns,
    text_literal,
)
from poiscope.operators.profile import duplicate_rows
from poiscope.plans.distincts import distinct_hashes, estimated_distincts, exact_distincts, few_valued, may_be_few, may_be_unique
from poiscope.plans.fused import Facts
from poiscope.plans.longform import per_column, per_text_column, spread, tally, union_all
from poiscope.plans.quantiles import exact_quantiles

# Limits and patterns of the issue rules.
CATEGORY_LIKE_BELOW = 15
DATE_IN_TEXT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
NUMERIC_SHARE = 0.8
FENCE = 1.5
OUTLIERS_PER_SCAN = 24
SHORT_TEXT = 8
LISTED_PARENTS = 10

Overrides = Mapping[str, list[str]] | None


def _found(df: DataFrame, role: str, overrides: Overrides) -> list[str]:
    return roles.resolve(df.columns, role, overrides)


# --- missing values and duplicates -----------------------------------------------------------


def critical_missing(df: DataFrame, overrides: Overrides = None) -> DataFrame:
    """Missing values of the columns the business depends on (only columns that have some)."""
    columns = _found(df, "critical", overrides)
    return (
        per_column(df, columns, {"missing_count": lambda c: f"count_if({missing_sql(df, c)})"})
        .filter(F.col("missing_count") > 0)
        .select("column", "missing_count", percent2(F.col("missing_count"), F.col("row_count")).alias("missing_pct"))
    )


def duplicate_issue(df: DataFrame) -> DataFrame:
    """The duplicate summary, if there are duplicates."""
    return duplicate_rows(df).filter(F.col("duplicate_count") > 0)


# --- types -----------------------------------------------------------------------------------


def numeric_as_categorical(df: DataFrame) -> DataFrame:
    """Numeric columns with more than one but fewer than 15 different values."""
    few = few_valued(df, numeric_columns(df), CATEGORY_LIKE_BELOW)
    return (
        exact_distincts(df, few)
        .filter((F.col("distinct_count") > 1) & (F.col("distinct_count") < CATEGORY_LIKE_BELOW))
        .select("column", "distinct_count")
    )


def _first_value_rows(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """(column, first_value) of each column as text; no row for a column without values."""
    return (
        per_column(df, columns, {"first_value": lambda c: f"CAST({first_by_sql(present_sql(df, c), *order_by)} AS STRING)"})
        .filter(F.col("first_value").isNotNull())
        .select("column", "first_value")
    )


def id_leading_zero(df: DataFrame, order_by: Sequence[str], overrides: Overrides = None) -> DataFrame:
    """Numeric identifier columns whose first value starts with a zero."""
    numeric = set(numeric_columns(df))
    columns = [c for c in _found(df, "identifier", overrides) if c in numeric]
    return _first_value_rows(df, columns, order_by).filter(F.col("first_value").startswith("0"))


def date_as_text(df: DataFrame, order_by: Sequence[str], overrides: Overrides = None) -> DataFrame:
    """Text columns of temporal name whose first value holds a date."""
    text = set(text_columns(df))
    columns = [c for c in _found(df, "temporal", overrides) if c in text]
    return _first_value_rows(df, columns, order_by).filter(F.col("first_value").rlike(DATE_IN_TEXT))


def _digits_only(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit("")).rlike("^[0-9]+$")


def number_as_text(df: DataFrame, overrides: Overrides = None) -> DataFrame:
    """Text columns of which more than 80 % of the values are digits and points."""
    skipped = set(_found(df, "never_numeric_text", overrides))
    columns = [c for c in text_columns(df) if c not in skipped]
    terms = {"digits_count": lambda v: F.count_if(_digits_only(v)), "value_count": F.count}
    share = F.try_divide(F.col("digits_count").cast("double"), F.col("value_count").cast("double"))
    return (
        per_text_column(df, columns, terms)
        .withColumn("digits_share", rounded(share, 6))
        .filter(share > NUMERIC_SHARE)
        .select("column", "digits_count", "value_count", "digits_share")
    )


def type_issues(df: DataFrame, order_by: Sequence[str], overrides: Overrides = None) -> DataFrame:
    """At most one type issue per column; a later rule replaces an earlier one."""
    ranked = union_all(
        [
            numeric_as_categorical(df).select("column", F.lit(1).alias("rule"), F.lit("numeric_as_categorical").alias("issue_type")),
            id_leading_zero(df, order_by, overrides).select("column", F.lit(2).alias("rule"), F.lit("id_leading_zero").alias("issue_type")),
            date_as_text(df, order_by, overrides).select("column", F.lit(3).alias("rule"), F.lit("date_as_text").alias("issue_type")),
            number_as_text(df, overrides).select("column", F.lit(4).alias("rule"), F.lit("number_as_text").alias("issue_type")),
        ]
    )
    return ranked.groupBy("column").agg(F.max_by("issue_type", "rule").alias("issue_type"))


def json_text_columns(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Text columns whose first value is a JSON object, with the schema of that value."""
    first = _first_value_rows(df, text_columns(df), order_by)
    parsed = F.try_parse_json(F.col("first_value"))
    return (
        first.filter(F.col("first_value").startswith("{") & F.col("first_value").endswith("}"))
        .filter(parsed.isNotNull())
        .select("column", F.schema_of_variant(parsed).alias("json_schema"))
    )


# --- outliers --------------------------------------------------------------------------------


def outlier_bounds(df: DataFrame, columns: Sequence[str], **limits) -> dict[str, tuple[float, float, float, float]]:
    """(q1, q3, lower fence, upper fence) of each column that has values."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.75), **limits)
    return {
        c: (q1, q3, q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
        for c, (q1, q3) in quartiles.items()
        if q1 is not None
    }


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, overrides: Overrides = None, **limits) -> DataFrame:
    """Numeric columns with values beyond the quartile fences; money and quantity columns with their impact.

    Two steps: exact quartiles, then one scan that counts and sums what lies beyond them.
    """
    if columns is None:
        exempt = set(_found(df, "outlier_exempt", overrides))
        columns = [c for c in numeric_columns(df) if c not in exempt]
    bounds = outlier_bounds(df, columns, **limits)
    fields = ("column", "q1", "q3", "outlier_count", "impact_min", "impact_max", "impact_mean", "impact_total")
    kept = [c for c in columns if c in bounds]
    if not kept:
        schema = "`column` string, q1 double, q3 double, outlier_count bigint, impact_min double, impact_max double, impact_mean double, impact_total double"
        return df.sparkSession.createDataFrame([], schema)
    money = set(_found(df, "money_or_quantity", overrides))
    frames = []
    for part in chunks(kept, OUTLIERS_PER_SCAN):
        terms = []
        for i, c in enumerate(part):
            v, (_, _, low, high) = present(df, c).cast("double"), bounds[c]
            beyond = (v < F.lit(low)) | (v > F.lit(high))
            costly = F.when(beyond, v) if c in money else F.lit(None).cast("double")
            terms += [
                F.count_if(beyond).alias(f"n{i}"),
                *[f(costly).alias(f"{label}{i}") for label, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("total", F.sum))],
            ]
        rows = [
            (F.lit(c), F.lit(bounds[c][0]), F.lit(bounds[c][1]), *[F.col(f"{label}{i}") for label in ("n", "min", "max", "mean", "total")])
            for i, c in enumerate(part)
        ]
        frames.append(spread(df.agg(*terms), fields, rows))
    return union_all(frames).filter(F.col("outlier_count") > 0)


# --- categories ------------------------------------------------------------------------------


def category_hierarchy(df: DataFrame, columns: Sequence[str] | None = None, overrides: Overrides = None) -> DataFrame:
    """Parents with more than one child, for every ordered pair of category columns.

    The table is first reduced to its distinct combinations of the category columns, in one
    shuffle with map-side combining; all pairs are read from those.
    """
    columns = list(columns or _found(df, "hierarchy", overrides))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "parent_column string, child_column string, parent string, child_count bigint")
    combos = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).distinct()
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("parent_column"), F.lit(b).alias("child_column"),
                F.col(f"c{i}").alias("parent"), F.col(f"c{j}").alias("child"),
            )
            for (i, a), (j, b) in combinations(enumerate(columns), 2)
        ]
    )
    return (
        combos.select(F.inline(pairs))
        .filter(F.col("parent").isNotNull() & F.col("child").isNotNull())
        .groupBy("parent_column", "child_column", "parent")
        .agg(F.count_distinct("child").alias("child_count"))
        .filter(F.col("child_count") > 1)
    )


def category_hierarchy_summary(df: DataFrame, columns: Sequence[str] | None = None, overrides: Overrides = None) -> DataFrame:
    """Per pair: how many parents are inconsistent, and the first ten of them by name."""
    detail = category_hierarchy(df, columns, overrides)
    pair = W.partitionBy("parent_column", "child_column")
    return (
        detail.withColumn("_place", F.row_number().over(pair.orderBy("parent")))
        .groupBy("parent_column", "child_column")
        .agg(
            F.count(F.lit(1)).alias("inconsistent_parents"),
            F.expr(f"listagg(parent, ', ') WITHIN GROUP (ORDER BY parent) FILTER (WHERE _place <= {LISTED_PARENTS})").alias("first_parents"),
        )
    )


# --- locations -------------------------------------------------------------------------------


def location_tests(df: DataFrame, overrides: Overrides = None) -> list[tuple[tuple[str, str], str]]:
    """((issue_type, column), SQL test of a row) of every location issue."""
    address = _found(df, "address_part", overrides)
    text = set(text_columns(df))
    entries = []
    for c in address:
        if c in text:
            entries.append((("empty_text", c), f"{quoted(c)} = ''"))
            entries.append((("short_text", c), f"length({quoted(c)}) < {SHORT_TEXT} AND {quoted(c)} <> ''"))
    if address:
        there = f"CAST({quoted(address[0])} AS STRING) <> ''"
        for g in _found(df, "geo", overrides):
            entries.append((("geo_missing_with_address", g), f"{there} AND {missing_sql(df, g)}"))
    return entries


def location_issues(df: DataFrame, overrides: Overrides = None) -> DataFrame:
    """Empty and short address texts, and coordinates missing although there is an address."""
    entries = location_tests(df, overrides)
    if not entries:
        return df.sparkSession.createDataFrame([], "issue_type string, `column` string, affected_rows bigint")
    return (
        tally(df, ("issue_type", "column"), entries)
        .filter(F.col("n") > 0)
        .select("issue_type", "column", F.col("n").alias("affected_rows"))
    )


# --- all of them -----------------------------------------------------------------------------


ISSUE = {"family": "string", "issue_type": "string", "column": "string", "detail": "string", "value": "double"}
TYPE_RULES = ("numeric_as_categorical", "id_leading_zero", "date_as_text", "number_as_text")


def find_issues(df: DataFrame, order_by: Sequence[str], overrides: Overrides = None) -> DataFrame:
    """Every issue as (family, issue_type, column, detail, value).

    Sketches, duplicates and quartiles are looked up first. All counters, first values and outliers then share one scan
    (`Facts`), all exact distinct counts a second, category pairs a third. Distinct values of keys are counted only
    where there are duplicates that a key would prevent, and on hashes.
    """
    copies = duplicate_rows(df).first()
    once = copies["row_count"] - copies["duplicate_count"]
    numeric, comparable = numeric_columns(df), comparable_columns(df)
    sketched = estimated_distincts(df, comparable if copies["duplicate_count"] else numeric)
    exempt = set(_found(df, "outlier_exempt", overrides))
    bounds = outlier_bounds(df, [c for c in numeric if c not in exempt])

    facts = _facts(df, order_by, bounds, overrides).frame()
    few = [c for c in numeric if may_be_few(sketched[c], CATEGORY_LIKE_BELOW)]
    keys = [c for c in comparable if copies["duplicate_count"] and may_be_unique(sketched[c], once)]
    text = lambda s: F.lit(s).cast("string")
    none = F.lit(None)

    def shaped(frame: DataFrame, family: str, kind: str, column: Column, detail: Column, value: Column, rule: int = 0) -> DataFrame:
        return frame.select(
            text(family).alias("family"), text(kind).alias("issue_type"), column.alias("column"),
            detail.cast("string").alias("detail"), value.cast("double").alias("value"), F.lit(rule).alias("rule"),
        )

    frames = [facts]
    if few or keys:
        # Each column is looked at for both: few values, or one for every distinct row.
        counted = distinct_hashes(df, list(dict.fromkeys([*few, *keys])))
        n, c = F.col("distinct_count"), F.col("column")
        is_few = c.isin(few) & (n > 1) & (n < CATEGORY_LIKE_BELOW)
        is_key = c.isin(keys) & (n == once) & (F.col("non_null_count") == copies["row_count"])
        kinds = F.array(
            F.when(is_few, F.struct(text("type_issues").alias("family"), text(TYPE_RULES[0]).alias("issue_type"), none.cast("double").alias("value"), F.lit(1).alias("rule"))),
            F.when(is_key, F.struct(text("potential_primary_keys").alias("family"), text("key_candidate").alias("issue_type"), n.cast("double").alias("value"), F.lit(0).alias("rule"))),
        )
        frames.append(
            counted.select("column", F.inline(F.array_compact(kinds))).select("family", "issue_type", "column", text(None).alias("detail"), "value", "rule")
        )
    if copies["duplicate_count"]:
        one = df.sparkSession.range(1)
        frames.append(shaped(one, "duplicate_rows", "duplicate_rows", text(None), none, F.lit(copies["duplicate_count"])))
    frames.append(
        shaped(
            category_hierarchy_summary(df, overrides=overrides), "category_hierarchy_issues", "category_hierarchy",
            F.concat("parent_column", F.lit("_to_"), "child_column"), F.col("first_parents"), F.col("inconsistent_parents"),
        )
    )
    found = union_all(frames)
    # At most one type issue per column: the one of the last rule.
    apart = F.when(F.col("family") == "type_issues", "").otherwise(F.col("issue_type"))
    last = found.groupBy("family", "column", apart.alias("_kind")).agg(F.max_by(F.struct("issue_type", "detail", "value"), "rule").alias("_last"))
    return last.select("family", "_last.issue_type", "column", "_last.detail", "_last.value")


def _facts(
    df: DataFrame, order_by: Sequence[str], bounds: Mapping[str, tuple[float, float, float, float]], overrides: Overrides
) -> Facts:
    """All issues that plain aggregates of the table can tell."""
    facts = Facts(df, ISSUE | {"rule": "int"})
    numeric, text = set(numeric_columns(df)), text_columns(df)
    roles_of = lambda role: set(_found(df, role, overrides))
    critical, identifiers, temporal, worded = map(roles_of, ("critical", "identifier", "temporal", "never_numeric_text"))
    money = roles_of("money_or_quantity")

    def issue(terms: Sequence[str], keep: str, family: str, kind: str, column: str, **more: str) -> None:
        facts.row(terms, keep, family=f"'{family}'", issue_type=f"'{kind}'", column=text_literal(column), rule=str(more.pop("rule", 0)), **more)

    rows = facts.term("count(1)")
    for c in df.columns:
        gaps = facts.term(f"count_if({missing_sql(df, c)})")
        issue([gaps], f"{gaps} > 0", "missing_values", "missing_values", c, value=gaps)
        if c in critical:
            issue([gaps], f"{gaps} > 0", "critical_missing_fields", "critical_missing", c, value=gaps)
        if c in identifiers & numeric:
            first = facts.term(f"CAST({first_by_sql(present_sql(df, c), *order_by)} AS STRING)")
            issue([first], f"startswith({first}, '0')", "type_issues", TYPE_RULES[1], c, rule=2)
        if c in text:
            first = facts.term(first_by_sql(quoted(c), *order_by))
            if c in temporal:
                issue([first], f"{first} RLIKE '{DATE_IN_TEXT}'", "type_issues", TYPE_RULES[2], c, rule=3)
            if c not in worded:
                digits = facts.term(f"count_if(replace({quoted(c)}, '.', '') RLIKE '^[0-9]+$')")
                share = f"try_divide(CAST({digits} AS DOUBLE), CAST({rows} - {gaps} AS DOUBLE))"
                issue([digits, gaps, rows], f"{share} > {NUMERIC_SHARE}D", "type_issues", TYPE_RULES[3], c, rule=4)
            parsed = f"try_parse_json({first})"
            shown = f"startswith({first}, '{{') AND endswith({first}, '}}') AND {parsed} IS NOT NULL"
            issue([first], shown, "json_columns", "json_text", c, detail=f"CASE WHEN {shown} THEN schema_of_variant({parsed}) END")
        if c in bounds:
            v, (low, high) = f"CAST({present_sql(df, c)} AS DOUBLE)", bounds[c][2:]
            beyond = f"({v} < double('{low!r}') OR {v} > double('{high!r}'))"
            n = facts.term(f"count_if({beyond})")
            issue([n], f"{n} > 0", "outliers", "iqr_outliers", c, value=n)
            if c in money:
                total = facts.term(f"sum(CASE WHEN {beyond} THEN {v} END)")
                issue([n, total], f"{n} > 0 AND {total} IS NOT NULL", "outlier_impact", "outlier_impact", c, value=total)
    for (kind, c), test in location_tests(df, overrides):
        n = facts.term(f"count_if({test})")
        issue([n], f"{n} > 0", "location_data_issues", kind, c, value=n)
    return facts
