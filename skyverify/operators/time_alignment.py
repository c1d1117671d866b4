"""Alignment of forecasts and observations in time.

Axes are what datasets are aligned by: the distinct runs, leads or valid times, which are as many as
there are times and not cells.  One job reads those of all datasets, they are combined as sorted
lists, and each dataset is brought to the result in one pass.  Cells that an outer alignment adds are
explicit rows with NULLs, at every place of the dataset's table of places, or of its cells if it has
no such table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_seconds
from ..model import Dataset, Time

_RUN = ("reference_time", "lead_s")


@dataclass(frozen=True)
class Axis:
    """The distinct times of a dataset, ascending: runs and leads of a forecast, valid times of observations."""

    runs: tuple[datetime, ...] = ()
    leads: tuple[int, ...] = ()
    times: tuple[datetime, ...] = ()


def axes_of(*datasets: Dataset) -> list[Axis]:
    """The axes of datasets, by one job; a null time is on no axis."""

    def row(k: int, d: Dataset) -> DataFrame:
        have = _RUN if d.is_forecast() else ("valid_time",)
        kinds = {"reference_time": "timestamp_ntz", "lead_s": "bigint", "valid_time": "timestamp_ntz"}
        sets = [(F.collect_set(F.col(c).cast(t)) if c in have else F.lit(None).cast(f"array<{t}>")).alias(c) for c, t in kinds.items()]
        return d.df.agg(*sets).select(F.lit(k).alias("k"), *kinds)

    rows = sorted(reduce(DataFrame.union, [row(k, d) for k, d in enumerate(datasets)]).collect())
    return [Axis(*(tuple(sorted(x or ())) for x in r[1:])) for r in rows]


def times_literal(values: Iterable[datetime]) -> Column:
    """An array of timestamps as one constant."""
    return F.filter(F.split(F.lit(",".join(v.isoformat(sep=" ") for v in values)), ","), lambda x: x != "").cast("array<timestamp_ntz>")


def leads_literal(values: Iterable[int]) -> Column:
    return F.filter(F.split(F.lit(",".join(map(str, values))), ","), lambda x: x != "").cast("array<bigint>")


def with_valid_time(df: DataFrame) -> DataFrame:
    return df.withColumn("valid_time", add_seconds(F.col("reference_time"), F.col("lead_s")))


def add_valid_time(ds: Dataset) -> Dataset:
    """The valid time of a forecast's cells; observations have theirs."""
    return ds.with_df(with_valid_time(ds.df)) if ds.is_forecast() else ds


def _places(ds: Dataset, others: list[str]) -> DataFrame:
    """What the dataset has beside times: its places (and members)."""
    if others == [ds.space_key] and ds.places is not None and ds.space_key in ds.places.columns:
        return ds.places.select(ds.space_key)
    return ds.df.select(*others).distinct()


def _on_axis(ds: Dataset, axis: dict[str, Column]) -> DataFrame:
    """Every place (and member) of ``ds`` at every time of ``axis``, with NULL where it has no cell."""
    others = [k for k in ds.keys if k not in axis]
    df = ds.df.drop("valid_time") if "reference_time" in axis else ds.df
    full = _places(ds, others) if others else ds.df.sparkSession.range(1).select()
    for name, values in axis.items():
        full = full.select("*", F.explode(values).alias(name))
    return full.join(df, [*axis, *others], "left")


def to_forecast_axis(ds: Dataset, runs: Iterable[datetime], leads: Iterable[int]) -> Dataset:
    """A forecast on runs x leads, with valid times."""
    return ds.with_df(with_valid_time(_on_axis(ds, {"reference_time": times_literal(runs), "lead_s": leads_literal(leads)})))


def to_observation_axis(ds: Dataset, times: Iterable[datetime]) -> Dataset:
    return ds.with_df(_on_axis(ds, {"valid_time": times_literal(times)}))


def _common(values: list[tuple]) -> list:
    return sorted(set.intersection(*map(set, values)))


def _either(values: list[tuple]) -> list:
    return sorted(set().union(*values))


def align_forecasts(a: Dataset, b: Dataset, only_common: bool = False) -> tuple[Dataset, Dataset]:
    """Runs that both have; leads of either, or of both with ``only_common``, which adds no cells."""
    axes = axes_of(a, b)
    runs = _common([x.runs for x in axes])
    if only_common:
        leads = _common([x.leads for x in axes])
        return tuple(d.with_df(d.df.where(F.col("reference_time").isin(runs) & F.col("lead_s").isin(leads))) for d in (a, b))
    leads = _either([x.leads for x in axes])
    return to_forecast_axis(a, runs, leads), to_forecast_axis(b, runs, leads)


def _aligned_observations(a: Dataset, b: Dataset, axes: list[Axis], only_common: bool) -> tuple[Dataset, Dataset]:
    if only_common:
        both = _common([x.times for x in axes])
        return tuple(d.with_df(d.df.where(F.col("valid_time").isin(both))) for d in (a, b))
    times = _either([x.times for x in axes])
    return to_observation_axis(a, times), to_observation_axis(b, times)


def align_observations(a: Dataset, b: Dataset, only_common: bool = False) -> tuple[Dataset, Dataset]:
    """Valid times of either, or of both with ``only_common``."""
    return _aligned_observations(a, b, axes_of(a, b), only_common)


def uniform_step(runs: Iterable[datetime]) -> int:
    """Seconds between runs; NotImplementedError if they differ, IndexError if there is a single run."""
    runs = sorted(runs)
    steps = {(b - a).total_seconds() for a, b in zip(runs, runs[1:], strict=False)}
    if not steps:
        raise IndexError("a single run has no step")
    if len(steps) > 1:
        raise NotImplementedError("reference times aren't evenly spaced")
    return int(steps.pop())


def stitch(fc: Dataset, lead_time: str = "start-min", axis: Axis | None = None) -> Dataset:
    """A forecast as one series in valid time, an observation by trait; run and lead stay as attributes.

    ``start-min`` takes each run up to the next one.  ``start-max`` takes whole runs, one in as many
    as the longest lead spans, without the last of the range; at a seam the shorter lead counts.
    """
    axis = axis or axes_of(fc)[0]
    step = uniform_step(axis.runs)
    if lead_time == "start-min":
        df = with_valid_time(fc.df.where(F.col("lead_s") < step))
    elif lead_time == "start-max":
        first, last, span = axis.runs[0], axis.runs[-1], axis.leads[-1] if axis.leads else 0
        if span < 1:
            raise ValueError("start-max needs leads above zero")
        runs = [r for r in axis.runs if (r - first).total_seconds() % span == 0 and r < last]
        want = -(-int((last - first).total_seconds()) // span)
        if len(runs) != want:
            raise KeyError(f"{want - len(runs)} of the {want} runs that start-max needs aren't there")
        others = [k for k in fc.keys if k not in _RUN]
        df = with_valid_time(fc.df.where(F.col("reference_time").isin(runs)))
        w = Window.partitionBy("valid_time", *others).orderBy("lead_s")
        df = df.withColumn("_nr", F.row_number().over(w)).where("_nr = 1").drop("_nr")
    else:
        raise ValueError(f"unknown choice of lead times {lead_time!r}")
    return fc.with_df(df.withColumnsRenamed({"reference_time": "run_time", "lead_s": "run_lead_s"})).with_time(Time.OBSERVATION)


def align_forecast_observation(fc: Dataset, obs: Dataset, only_common: bool = False, lead_time: str = "start-min") -> tuple[Dataset, Dataset]:
    return align_observations(stitch(fc, lead_time), obs, only_common)


def covered_runs(obs: Axis, fc: Axis) -> list[datetime]:
    """Runs that start when observations have begun and end, with the longest lead, before they stop."""
    if not obs.times or not fc.leads:
        raise ValueError("no observation or no forecast")
    span = timedelta(seconds=fc.leads[-1])
    out = [r for r in fc.runs if obs.times[0] <= r and r + span <= obs.times[-1]]
    if not out:
        raise ValueError("observations cover no run whole")
    return out


def _looked_up(obs: Dataset, own: Axis, axis: Axis, on_missing: str) -> tuple[Dataset, list[datetime]]:
    """Observations at every lead of the runs that they cover, and those runs."""
    runs = covered_runs(own, axis)
    if on_missing == "raise":
        have = set(own.times)
        if gap := next((t for r in runs for s in axis.leads if (t := r + timedelta(seconds=s)) not in have), None):
            raise KeyError(f"no observation at {gap}")
    start = add_seconds(F.col("valid_time"), -F.col("lead_s"))
    rows = obs.df.select("*", F.explode(leads_literal(axis.leads)).alias("lead_s")).withColumn("reference_time", start).where(F.col("reference_time").isin(runs))
    return obs.with_df(rows.select(*_RUN, *obs.df.columns)).with_time(Time.FORECAST), runs


def align_observation_forecast(obs: Dataset, fc: Dataset, only_common: bool = False, on_missing: str = "raise") -> tuple[Dataset, Dataset]:
    """Observations looked up at every run and lead; they become a forecast by trait.

    Runs that the observations don't cover are cut.  Within the rest each valid time must exist, or
    KeyError; ``on_missing="null"`` gives NULLs instead.  With ``only_common`` both sides are cut,
    else the observations have NULLs for the cut runs and the forecast is whole.
    """
    own, axis = axes_of(obs, fc)
    found, runs = _looked_up(obs, own, axis, on_missing)
    if only_common:
        return found, fc.with_df(fc.df.where(F.col("reference_time").isin(runs)))
    return to_forecast_axis(found, axis.runs, axis.leads), add_valid_time(fc)


def align_pair(a: Dataset, b: Dataset, **options) -> tuple[Dataset, Dataset]:
    """Dispatch on the two time traits."""
    if a.is_forecast():
        return align_forecasts(a, b, **options) if b.is_forecast() else align_forecast_observation(a, b, **options)
    return align_observation_forecast(a, b, **options) if b.is_forecast() else align_observations(a, b, **options)


def align_time(datasets: Iterable[Dataset] | dict[str, Dataset], return_as: str = "forecast", on_missing: str = "raise") -> list[Dataset]:
    """All datasets on one axis: common runs and all leads of the forecasts, or all valid times if there is none."""
    if return_as != "forecast":
        raise NotImplementedError(f"return_as={return_as!r}")
    sets = list(datasets.values() if isinstance(datasets, dict) else datasets)
    if not sets:
        raise ValueError("no dataset to align")
    axes = axes_of(*sets)
    forecasts = [x for d, x in zip(sets, axes, strict=True) if d.is_forecast()]
    if not forecasts:
        times = _either([x.times for x in axes])
        return [to_observation_axis(d, times) for d in sets]
    axis = Axis(tuple(_common([x.runs for x in forecasts])), tuple(_either([x.leads for x in forecasts])))
    return [to_forecast_axis(d if d.is_forecast() else _looked_up(d, x, axis, on_missing)[0], axis.runs, axis.leads) for d, x in zip(sets, axes, strict=True)]


@dataclass(frozen=True)
class TimeAccessor:
    ds: Dataset

    def is_forecast(self) -> bool:
        return self.ds.is_forecast()

    def is_observation(self) -> bool:
        return self.ds.is_observation()

    def add_valid_time(self) -> Dataset:
        return add_valid_time(self.ds)

    def align_with(self, other: Dataset, **options) -> tuple[Dataset, Dataset]:
        return align_pair(self.ds, other, **options)
