"""Operators for preparing training text: deduplication, filters, extraction, tokens."""
