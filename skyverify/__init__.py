"""Alignment and verification of forecasts against observations on Spark."""

from .functions.dates import Dates
from .functions.projections import load_presets
from .model import Dataset, Properties, Space, Time, Uncertainty, validate
from .operators import Metric, align_space, align_time, available_interpolations, available_transformations, broadcast_nulls, interpolate, rank_histogram, register_interpolator, register_transformation, transform, verify, verify_ensemble
from .plans import Config, Runner
from .sources import available_loaders, load, register_loader, save_dataset, save_metrics

__all__ = [
    "Config", "Dataset", "Dates", "Metric", "Properties", "Runner", "Space", "Time", "Uncertainty", "align_space", "align_time", "available_interpolations", "available_loaders",
    "available_transformations", "broadcast_nulls", "interpolate", "load", "load_presets", "rank_histogram", "register_interpolator", "register_loader", "register_transformation", "save_dataset", "save_metrics",
    "transform", "validate", "verify", "verify_ensemble",
]
