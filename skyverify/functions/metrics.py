"""Error metrics as column aggregates of (prediction a, reference b)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name to function of (a, b) that gives an aggregate; pairs with a NULL are NULL already.
METRICS: dict[str, Callable[[Column, Column], Column]] = {}


def register_metric(name: str):
    """Register an aggregate of columns under a name."""

    def add(fn):
        METRICS[name] = fn
        return fn

    return add


@register_metric("bias")
def bias(a: Column, b: Column) -> Column:
    return F.avg(a - b)


@register_metric("mae")
def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


@register_metric("mse")
def mse(a: Column, b: Column) -> Column:
    return F.avg((a - b) * (a - b))


@register_metric("rmse")
def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mse(a, b))


@register_metric("mape")
def mape(a: Column, b: Column) -> Column:
    """Relative to the reference; pairs with a reference of zero don't count."""
    return F.avg(F.abs(F.try_divide(a - b, b)))


@register_metric("median_absolute_error")
def median_absolute_error(a: Column, b: Column) -> Column:
    return F.percentile(F.abs(a - b), 0.5)


@register_metric("pearson_r")
def pearson_r(a: Column, b: Column) -> Column:
    return F.corr(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))


#: Metrics of an ensemble: functions of (array of the members' predictions, reference) for one cell; their mean counts.
ENSEMBLE: dict[str, Callable[[Column, Column], Column]] = {}


def register_ensemble_metric(name: str):
    """Register a column function of one cell's members and reference under a name."""

    def add(fn):
        ENSEMBLE[name] = fn
        return fn

    return add


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean_of(values: Column) -> Column:
    return F.try_divide(_total(values), F.size(values))


@register_ensemble_metric("crps_ensemble")
def crps_ensemble(members: Column, b: Column) -> Column:
    """Continuous ranked probability score: mean distance to the reference less half the members' mean distance.

    In ascending order the i-th of m members is subtracted and added m - 1 and i - 1 times, so no
    pairs are made.
    """
    m = F.size(members)
    ranked = F.transform(F.array_sort(members), lambda x, i: x * (2.0 * i - m + 1))
    return _mean_of(F.transform(members, lambda x: F.abs(x - b))) - F.try_divide(_total(ranked), m.cast("double") * m)


@register_ensemble_metric("spread")
def spread(members: Column, b: Column) -> Column:
    """Standard deviation of the members, NULL for one alone."""
    mean = _mean_of(members)
    return F.sqrt(F.try_divide(_total(F.transform(members, lambda x: (x - mean) * (x - mean))), F.when(F.size(members) > 1, F.size(members) - 1)))


@register_ensemble_metric("ensemble_bias")
def ensemble_bias(members: Column, b: Column) -> Column:
    return _mean_of(members) - b


@register_ensemble_metric("rank_of_reference")
def rank_of_reference(members: Column, b: Column) -> Column:
    """How many members are below the reference; see ``rank_histogram`` for counts."""
    return F.size(F.filter(members, lambda x: x < b)).cast("double")


def brier_score(threshold: float) -> Callable[[Column, Column], Column]:
    """An ensemble metric: squared error of the share of members above ``threshold``."""

    def score(members: Column, b: Column) -> Column:
        share = F.try_divide(F.size(F.filter(members, lambda x: x > threshold)), F.size(members))
        return F.pow(share - F.when(b > threshold, 1.0).otherwise(0.0), 2.0)

    return score


def resolve_function(path: str) -> Callable:
    """The function at a dotted path, with a plain error if there is none."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ImportError(f"{path!r} is no dotted path to a function")
    try:
        found = importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"can't import {module!r} for {path!r}: {e}") from e
    if not hasattr(found, name):
        raise AttributeError(f"module {module!r} has no {name!r}")
    return getattr(found, name)


def is_registered(function: str | Callable) -> bool:
    """Whether ``aggregate`` takes the function from METRICS."""
    return isinstance(function, str) and function.rpartition(".")[2] in METRICS


def aggregate(function: str | Callable, a: Column, b: Column, skipna: bool = True) -> Column:
    """A registered metric by name, or a function of two numpy arrays that gives a number.

    Without ``skipna`` one NULL on either side makes the result NULL.
    """
    paired = a.isNotNull() & b.isNotNull()
    a, b = F.when(paired, a.cast("double")), F.when(paired, b.cast("double"))
    if is_registered(function):
        out = METRICS[function.rpartition(".")[2]](a, b)
    else:
        fn = resolve_function(function) if isinstance(function, str) else function

        def run(x, y):  # a grouped aggregate; values of a group meet in one task
            keep = x.notna() & y.notna()
            return float(fn(x[keep].to_numpy(), y[keep].to_numpy())) if (keep.any() if skipna else len(keep) and keep.all()) else None

        import pandas as pd

        run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": float}
        return F.pandas_udf(run, "double")(a, b)
    return out if skipna else F.when(F.count(F.when(paired, 1)) == F.count(F.lit(1)), out)
