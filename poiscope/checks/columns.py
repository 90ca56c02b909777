"""Column lists of the tables the checks use, for SQL that names every column."""

from __future__ import annotations

from collections.abc import Iterable

# Fixed values: (column, Spark type) of the derived locations table and of the provided tables used.
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
LOCATION_TYPES = {
    "location_id": "bigint", "name": "string", "chain_id": "string", "chain_name": "string",
    "main_category": "string", "sub_category": "string", "address": "string", "city": "string",
    "state": "string", "postal_code": "string", "latitude": "double", "longitude": "double",
    "website": "string", "phone": "string", "email": "string",
    **{f"{d}_{edge}": "string" for d in _DAYS for edge in ("open", "close")},
    "open_closed_status": "string", "opened_on": "date", "opened_date_text": "string",
    "data_quality_confidence_score": "double", "popularity_score": "double", "sentiment_score": "double",
    "dwell_time": "double", "price_amount": "double", "store_number_text": "string", "props": "string",
}
LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
LOCATION_COLUMNS = list(LOCATION_TYPES)
LINEITEM_COLUMNS = list(LINEITEM_TYPES)


def union_per_column(columns: Iterable[str], template: str) -> str:
    """UNION ALL of the template for each column; {c} is the name and {i} its position."""
    return "\nUNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))
