"""Dates, projections and metrics."""
