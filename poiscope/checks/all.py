"""Loads every registering module."""

from poiscope.checks import (  # noqa: F401
    chart_queries,
    cleaning_queries,
    dimension_queries,
    issue_queries,
    location_queries,
    pattern_queries,
    profile_queries,
    source_queries,
)
from poiscope.checks.registry import QUERIES, SQL  # noqa: F401
