"""Alignment in time and space, interpolation, masks, transformations and verification."""

from .space_alignment import align_space
from .time_alignment import align_time
from .interpolate import available_interpolations, interpolate, register_interpolator
from .mask import broadcast_nulls
from .transform import available_transformations, register_transformation, transform
from .verify import Metric, rank_histogram, verify, verify_ensemble

__all__ = ["Metric", "align_space", "align_time", "available_interpolations", "available_transformations", "broadcast_nulls", "interpolate", "rank_histogram", "register_interpolator", "register_transformation", "transform", "verify", "verify_ensemble"]
