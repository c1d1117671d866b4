"""Observations that arrive as a stream."""

from .observations import observation_means, pair_stream

__all__ = ["observation_means", "pair_stream"]
