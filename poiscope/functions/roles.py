"""Which columns play which part, decided from their names.

A role is either a list of whole names or a list of substrings; both ignore case. Every
operator that uses a role also accepts explicit columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

# Names and substrings per role, in order of the profile, issue and outlier rules.
WHOLE_NAME = {
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "long", "lng"),
    "business_name": ("name", "business_name", "store_name", "poi_name"),
    "category": ("category", "categories", "classification", "type", "business_type"),
    "address": ("address", "street", "street_address"),
}
SUBSTRING = {
    "phone": ("phone",),
    "temporal": ("date", "time", "year", "month", "day"),
    "critical": (
        "address", "location", "gps", "lat", "lon", "lng", "coord",
        "product", "sku", "upc", "ean", "brand", "category", "price",
        "store", "outlet", "chain", "retailer",
    ),
    "identifier": ("id", "code", "sku", "upc", "ean", "gtin"),
    "outlier_exempt": ("id", "code", "sku", "upc", "ean"),
    "money_or_quantity": ("price", "cost", "amount", "quantity", "qty", "volume"),
    "never_numeric_text": ("name", "description", "address", "city", "state"),
    "hierarchy": ("category", "segment", "department", "class"),
    "address_part": ("address", "street", "city", "state", "zip", "postal"),
    "geo": ("lat", "lon", "lng", "latitude", "longitude", "coord"),
}


def matches(name: str, role: str) -> bool:
    low = name.lower()
    if role in WHOLE_NAME:
        return low in WHOLE_NAME[role]
    return any(term in low for term in SUBSTRING[role])


def resolve(columns: Iterable[str], role: str, overrides: Mapping[str, list[str]] | None = None) -> list[str]:
    """Columns of a role in table order; an override for the role wins."""
    if overrides and role in overrides:
        return list(overrides[role])
    return [c for c in columns if matches(c, role)]


def first(columns: Iterable[str], role: str, overrides: Mapping[str, list[str]] | None = None) -> str | None:
    found = resolve(columns, role, overrides)
    return found[0] if found else None
