"""Datasets: one DataFrame row for each cell, with traits that steer every operator."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Space(StrEnum):
    GRID = "grid"
    POINT = "point"


class Time(StrEnum):
    FORECAST = "forecast"
    OBSERVATION = "observation"


class Uncertainty(StrEnum):
    DETERMINISTIC = "deterministic"
    ENSEMBLE = "ensemble"
    QUANTILE = "quantile"


@dataclass(frozen=True)
class Properties:
    space: Space
    time: Time
    uncertainty: Uncertainty = Uncertainty.DETERMINISTIC

    def to_attrs(self) -> dict[str, str]:
        return {"space": str(self.space), "time": str(self.time), "uncertainty": str(self.uncertainty)}

    @classmethod
    def from_attrs(cls, attrs: dict[str, str]) -> Properties:
        """Space and time must be there (KeyError); uncertainty defaults to deterministic."""
        return cls(Space(attrs["space"]), Time(attrs["time"]), Uncertainty(attrs.get("uncertainty", "deterministic")))


#: Key columns that each trait accepts: any one set.  Lead times are whole seconds.
DIMS: dict[StrEnum, list[set[str]]] = {
    Space.GRID: [{"xc", "yc"}, {"grid_index"}, {"longitude", "latitude"}],
    Space.POINT: [{"point_index"}],
    Time.FORECAST: [{"reference_time", "lead_s"}],
    Time.OBSERVATION: [{"valid_time"}],
    Uncertainty.DETERMINISTIC: [],
    Uncertainty.ENSEMBLE: [{"member"}],
    Uncertainty.QUANTILE: [{"quantile"}],
}
#: Columns that must be there besides, as keys, attributes or in the space table.
COORDS: dict[StrEnum, set[str]] = {
    Space.GRID: {"longitude", "latitude"}, Space.POINT: {"longitude", "latitude"}, Time.FORECAST: {"reference_time", "lead_s"}, Time.OBSERVATION: {"valid_time"},
    Uncertainty.DETERMINISTIC: set(), Uncertainty.ENSEMBLE: {"member"}, Uncertainty.QUANTILE: {"quantile"},
}
KEYS = ("reference_time", "lead_s", "valid_time", "member", "quantile", "grid_index", "point_index", "yc", "xc", "latitude", "longitude")
ATTRIBUTES = ("code", "elevation", "altitude", "name", "country")


def keys_of(columns: Iterable[str]) -> tuple[str, ...]:
    """Key columns among ``columns``, in canonical order."""
    have = set(columns)
    keys = have & set(KEYS)
    if {"reference_time", "lead_s"} <= keys:
        keys.discard("valid_time")  # it follows from them
    if keys & {"grid_index", "point_index"}:
        keys -= {"xc", "yc", "longitude", "latitude"}
    elif {"xc", "yc"} <= keys:
        keys -= {"longitude", "latitude"}
    return tuple(k for k in KEYS if k in keys)


def infer_properties(columns: Iterable[str]) -> Properties:
    """Traits from column names alone."""
    have = set(columns)
    if {"reference_time", "lead_s"} <= have:
        time = Time.FORECAST
    elif "valid_time" in have:
        time = Time.OBSERVATION
    else:
        raise ValueError("no time trait fits: neither reference_time and lead_s, nor valid_time")
    if have & {"grid_index", "xc"} or ("latitude" in have and "point_index" not in have):
        space = Space.GRID
    elif "point_index" in have:
        space = Space.POINT
    else:
        raise ValueError("no space trait fits: neither grid_index, xc or latitude, nor point_index")
    uncertainty = Uncertainty.ENSEMBLE if "member" in have else Uncertainty.QUANTILE if "quantile" in have else Uncertainty.DETERMINISTIC
    return Properties(space, time, uncertainty)


@dataclass(frozen=True)
class Dataset:
    """A cube: ``df`` has a row for each cell, ``places`` the coordinates of each grid or point index."""

    df: DataFrame
    properties: Properties
    places: DataFrame | None = None
    crs: dict | None = None
    grid: dict | None = None
    name: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        return keys_of(self.df.columns)

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in KEYS and c not in ATTRIBUTES]

    @property
    def space_key(self) -> str | None:
        return next((k for k in ("grid_index", "point_index") if k in self.df.columns), None)

    @property
    def coords(self) -> set[str]:
        return {c for c in self.df.columns if c in KEYS or c in ATTRIBUTES} | set(self.places.columns if self.places is not None else ())

    def with_df(self, df: DataFrame, **changes) -> Dataset:
        return replace(self, df=df, **changes)

    def with_space(self, space: Space) -> Dataset:
        out = replace(self, properties=replace(self.properties, space=space))
        validate(out)
        return out

    def with_time(self, time: Time) -> Dataset:
        out = replace(self, properties=replace(self.properties, time=time))
        validate(out)
        return out

    def select(self, variables: str | list[str]) -> Dataset:
        names = [variables] if isinstance(variables, str) else list(variables)
        if missing := [v for v in names if v not in self.variables]:
            raise KeyError(f"no such variable: {', '.join(missing)}")
        return self.with_df(self.df.select(*[c for c in self.df.columns if c not in self.variables], *names))

    def is_forecast(self) -> bool:
        return self.properties.time == Time.FORECAST

    def is_observation(self) -> bool:
        return self.properties.time == Time.OBSERVATION

    def is_grid(self) -> bool:
        return self.properties.space == Space.GRID

    def is_point(self) -> bool:
        return self.properties.space == Space.POINT

    @property
    def time(self):
        """Operators on the time axis."""
        from .operators.time_alignment import TimeAccessor

        return TimeAccessor(self)

    @property
    def space(self):
        """Operators on places."""
        from .operators.space_alignment import SpaceAccessor

        return SpaceAccessor(self)


def validate_trait(ds: Dataset, trait: StrEnum) -> None:
    keys, allowed = set(ds.keys) | ({"valid_time"} & set(ds.df.columns)), DIMS[trait]
    if allowed and not any(s <= keys for s in allowed):
        raise ValueError(f"{trait}: keys {sorted(keys)} hold none of {[sorted(s) for s in allowed]}")
    if missing := COORDS[trait] - ds.coords:
        raise ValueError(f"{trait}: no {', '.join(sorted(missing))}")


def validate_time(ds: Dataset) -> None:
    validate_trait(ds, ds.properties.time)


def validate_space(ds: Dataset) -> None:
    validate_trait(ds, ds.properties.space)


def validate_uncertainty(ds: Dataset) -> None:
    validate_trait(ds, ds.properties.uncertainty)


def validate(ds: Dataset) -> None:
    """Checks names of keys and coordinates against the traits; ValueError says what is missing."""
    validate_time(ds)
    validate_space(ds)
    validate_uncertainty(ds)


def without_nan(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Missing values as NULL throughout: NaN becomes NULL."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if kinds[c] in ("double", "float")})
