"""Transformations of variables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.metrics import resolve_function
from ..model import Dataset

_TRANSFORMATIONS: dict[str, Callable] = {}


def register_transformation(name: str):
    """Register a function of (dataset, **options) that gives a dataset."""

    def add(fn):
        _TRANSFORMATIONS[name] = fn
        return fn

    return add


def available_transformations() -> list[str]:
    return sorted(_TRANSFORMATIONS)


def get_transformation(name: str) -> Callable:
    if name not in _TRANSFORMATIONS:
        raise ValueError(f"unknown transformation {name!r}; there are {', '.join(available_transformations())}")
    return _TRANSFORMATIONS[name]


def transform(name: str, datasets: Dataset | list | dict, *args, **options):
    """Apply to one dataset, a list or a dict; a list or dict of one comes back unwrapped."""
    fn = get_transformation(name)
    if isinstance(datasets, Dataset):
        return fn(datasets, *args, **options)
    out = {k: fn(d, *args, **options) for k, d in (datasets.items() if isinstance(datasets, dict) else enumerate(datasets))}
    if len(out) == 1:
        return next(iter(out.values()))
    return out if isinstance(datasets, dict) else list(out.values())


@register_transformation("rename")
def rename(ds: Dataset, rename_dict: dict[str, str | list[str]]) -> Dataset:
    """``{new: old or [olds]}``; olds that aren't there don't matter, two that are there clash."""
    names = {}
    for new, olds in rename_dict.items():
        found = [v for v in ds.variables if v in ([olds] if isinstance(olds, str) else olds)]
        if len(found) > 1 or (found and new in ds.df.columns and new not in found):
            raise ValueError(f"several variables would be {new!r}: {', '.join([*found, new] if new in ds.df.columns else found)}")
        names |= {old: new for old in found}
    return ds.with_df(ds.df.withColumnsRenamed(names))


@register_transformation("kelvin_to_celcius")
def kelvin_to_celsius(ds: Dataset, variables: str | list[str], inverse: bool = False) -> Dataset:
    names = [variables] if isinstance(variables, str) else variables
    shift = F.lit(273.15)
    return ds.with_df(ds.df.withColumns({v: F.col(f"`{v}`") + shift if inverse else F.col(f"`{v}`") - shift for v in names}))


register_transformation("kelvin_to_celsius")(kelvin_to_celsius)


@register_transformation("uv_to_speed")
def uv_to_speed(ds: Dataset, u: str, v: str, speed: str) -> Dataset:
    a, b = F.col(f"`{u}`"), F.col(f"`{v}`")
    return ds.with_df(ds.df.withColumn(speed, F.sqrt(a * a + b * b)))


@register_transformation("external")
def external(ds: Dataset, func_path: str, inputs: dict[str, str], output: str, vectorised: bool = False, **options) -> Dataset:
    """A function at a dotted path, argument names bound to variables, its result under ``output``.

    It is called with columns and stays in the engine, or with ``vectorised`` with pandas series.
    """
    fn = resolve_function(func_path)
    names = list(inputs)
    columns = [F.col(f"`{inputs[n]}`") for n in names]
    if not vectorised:
        made = fn(**dict(zip(names, columns, strict=True)), **options)
        if not isinstance(made, Column):
            raise TypeError(f"{func_path} gave no column; with vectorised=True it gets series")
    else:
        import pandas as pd

        def run(*series):
            return pd.Series(fn(**dict(zip(names, series, strict=True)), **options)).astype("float64")

        made = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(*columns)
    return ds.with_df(ds.df.withColumn(output, made))
