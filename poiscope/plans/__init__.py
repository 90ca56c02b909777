"""Reusable multi-step plans: exact quantiles, distinct counts, global order."""
