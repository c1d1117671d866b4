"""Small functions, as examples for the ``external`` transformation and for metrics."""

from __future__ import annotations


def ratio(part, whole, scale=1.0):
    """``scale * part / whole``; works on columns and on series."""
    return part * scale / whole


def largest_error(a, b):
    """The largest distance of two arrays; an example of a metric."""
    return abs(a - b).max()
