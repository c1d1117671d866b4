"""Pipelines from a configuration, and the registered queries."""

from .config import Config
from .runner import Runner

__all__ = ["Config", "Runner"]
