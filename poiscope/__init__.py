"""Profiling, grading, cleaning and location analytics for tables, as Spark plans."""

__version__ = "0.1.0"
