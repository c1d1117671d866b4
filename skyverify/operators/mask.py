"""One pattern of missing values for all datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Dataset


def one_frame(datasets: dict[str, Dataset], variables: list[str]) -> DataFrame:
    """All datasets' cells after each other: ``model``, their keys, and ``variables``, NULL where one lacks it."""
    keys = _common_keys(datasets)
    kinds = {v: t for d in datasets.values() for v, t in d.df.dtypes if v in variables}

    def rows(model: str, d: Dataset) -> DataFrame:
        return d.df.select(F.lit(model).alias("model"), *keys, *[(F.col(f"`{v}`") if v in d.variables else F.lit(None)).cast(kinds[v]).alias(v) for v in variables])

    return reduce(DataFrame.union, [rows(m, d) for m, d in datasets.items()])


def _common_keys(datasets: dict[str, Dataset]) -> list[str]:
    first, *rest = datasets.values()
    for d in rest:
        if set(d.keys) != set(first.keys):
            raise ValueError(f"keys differ: {list(first.keys)} and {list(d.keys)}")
    return list(first.keys)


def masked_frame(datasets: dict[str, Dataset]) -> DataFrame:
    """``one_frame`` of all variables, where a cell that is NULL in any dataset that has it is NULL in all.

    One exchange by key brings the cells of all datasets together.
    """
    keys = _common_keys(datasets)
    names = sorted({v for d in datasets.values() for v in d.variables})
    every, w = one_frame(datasets, names), Window.partitionBy(*keys)

    def masked(v: str):
        owners = [m for m, d in datasets.items() if v in d.variables]
        missing = F.max(F.when(F.col("model").isin(owners), F.col(f"`{v}`").isNull())).over(w)
        return F.when(~missing, F.col(f"`{v}`")).alias(v) if len(owners) > 1 else F.col(f"`{v}`")

    return every.select("model", *keys, *[masked(v) for v in names])


def broadcast_nulls(datasets: dict[str, Dataset] | list[Dataset]) -> dict[str, Dataset] | list[Dataset]:
    """A cell that is NULL in any dataset that has it becomes NULL in all, variable by variable.

    All must have the same keys.  A single dataset comes back as it is.  Each dataset is a part of
    ``masked_frame``, which metrics over all of them use as a whole.
    """
    named = datasets if isinstance(datasets, dict) else {str(k): d for k, d in enumerate(datasets)}
    if len(named) < 2:
        return datasets
    every, keys = masked_frame(named), _common_keys(named)

    def part(model: str, d: Dataset) -> Dataset:
        derived = {"valid_time"} & set(d.df.columns) - set(keys)
        df = every.where(F.col("model") == model).select(*keys, *[F.col(f"`{v}`") for v in d.variables])
        if derived and {"reference_time", "lead_s"} <= set(keys):
            from .time_alignment import with_valid_time

            df = with_valid_time(df)
        return d.with_df(df, extra=d.extra | {"frame": (every, model, df)})

    out = {m: part(m, d) for m, d in named.items()}
    return out if isinstance(datasets, dict) else list(out.values())
