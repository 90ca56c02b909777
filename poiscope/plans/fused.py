"""Facts of many kinds from one scan: shared aggregates, and the rows that are made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from poiscope.plans.longform import _inlined, union_all

# Aggregates of one scan: keeps generated code inside the JVM's method size.
TERMS_PER_SCAN = 150


class Facts:
    """Rows of given fields, each an expression over aggregates of one table.

    `term` names an aggregate, the same one for the same SQL however often it is asked for. `row` adds a row that
    appears if its condition holds. All rows come from one scan as long as their terms fit in one.
    """

    def __init__(self, df: DataFrame, fields: Mapping[str, str]):
        self.df, self.fields = df, fields
        self._terms: dict[str, str] = {}
        self._rows: list[tuple[set[str], dict[str, str]]] = []

    def term(self, sql: str) -> str:
        return self._terms.setdefault(sql, f"t{len(self._terms)}")

    def row(self, terms: Sequence[str], keep: str, **values: str) -> None:
        """A row of values by field (SQL over names of terms; left out: NULL), shown where `keep` is true."""
        typed = {f: f"CAST({values.get(f, 'NULL')} AS {kind})" for f, kind in self.fields.items()}
        self._rows.append((set(terms), typed | {"_keep": f"({keep}) IS TRUE"}))

    def _scans(self) -> list[tuple[set[str], list[dict[str, str]]]]:
        scans: list[tuple[set[str], list[dict[str, str]]]] = []
        for terms, row in self._rows:
            if not scans or len(scans[-1][0] | terms) > TERMS_PER_SCAN:
                scans.append((set(), []))
            scans[-1][0].update(terms)
            scans[-1][1].append(row)
        return scans

    def frame(self) -> DataFrame:
        if not self._rows:
            return self.df.sparkSession.createDataFrame([], ", ".join(f"`{f}` {kind}" for f, kind in self.fields.items()))
        frames = []
        for terms, rows in self._scans():
            one = self.df.selectExpr(*[f"{sql} AS {name}" for sql, name in self._terms.items() if name in terms] or ["count(1) AS n"])
            frames.append(one.selectExpr(_inlined(rows)).filter("_keep").drop("_keep"))
        return union_all(frames)
