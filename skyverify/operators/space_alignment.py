"""Grids: projections, stacking, equality; and alignment of grids with grids or points."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.projections import PRESETS, project, project_point, resolve_crs
from ..model import Dataset
from .interpolate import interpolate_one

#: Two grids are the same if |a - b| <= ATOL + RTOL * |b| degrees at every cell.
ATOL, RTOL = 1e-4, 1e-5
_GRID_KEYS = ("nx", "ny", "lon_ll", "lat_ll", "dx", "dy")


def add_crs(ds: Dataset, crs: str | dict) -> Dataset:
    if ds.is_point():
        raise ValueError("points have no projection of their own")
    return ds.with_df(ds.df, crs=resolve_crs(crs))


def add_grid_mapping(ds: Dataset, grid: str | dict) -> Dataset:
    """A grid definition, or a preset's."""
    if ds.is_point():
        raise ValueError("points have no grid mapping")
    if isinstance(grid, str):
        if grid.lower() not in PRESETS:
            raise ValueError(f"unknown preset {grid!r}; there are {', '.join(sorted(PRESETS))}")
        grid = PRESETS[grid.lower()]["kws_grid"]
    return ds.with_df(ds.df, grid=dict(grid))


def add_xy(ds: Dataset, crs: str | dict | None = None) -> Dataset:
    """Projected ``xc`` and ``yc`` of every place; unchanged if they are there."""
    crs = resolve_crs(crs) if crs is not None else ds.crs
    if {"xc", "yc"} <= ds.coords:
        return ds
    if crs is None:
        raise ValueError("no crs")
    if ds.places is None:
        raise ValueError("longitude and latitude must be coordinates, not keys")
    x, y = project(crs, F.col("longitude"), F.col("latitude"))
    return ds.with_df(ds.df, places=ds.places.withColumns({"xc": x, "yc": y}), crs=crs if ds.is_grid() else ds.crs)


def is_stacked(ds: Dataset) -> bool:
    have = set(ds.df.columns)
    if {"xc", "yc"} <= have or {"longitude", "latitude"} <= have:
        return False
    if "grid_index" in have:
        return True
    raise ValueError("neither two grid keys nor grid_index")


def _pair(ds: Dataset) -> tuple[str, str]:
    have = set(ds.df.columns)
    for y, x in (("yc", "xc"), ("latitude", "longitude"), ("lat", "lon")):
        if {y, x} <= have:
            return y, x
    raise ValueError("no pair of grid keys")


def stack(ds: Dataset) -> Dataset:
    """Two grid keys become ``grid_index``, rows of y after each other."""
    if ds.is_point():
        raise ValueError("points can't be stacked")
    if is_stacked(ds):
        return ds
    y, x = _pair(ds)
    nx, df = ds.df.agg(F.countDistinct(x)).first()[0], ds.df
    for c in (y, x):  # ranks over the axes, which are as long as the grid is wide
        axis = ds.df.select(c).distinct().select(F.col(c).alias("_at"), (F.row_number().over(Window.orderBy(c)) - 1).cast("long").alias(f"_{c}"))
        df = df.join(axis, F.col(c) == F.col("_at")).drop("_at")
    df = df.withColumn("grid_index", F.col(f"_{y}") * nx + F.col(f"_{x}")).drop(f"_{y}", f"_{x}")
    own = [c for c in (y, x, "longitude", "latitude") if c in df.columns]
    places = df.select("grid_index", *dict.fromkeys(own)).dropDuplicates(["grid_index"])
    if ds.places is not None:
        places = places.join(ds.places, [y, x], "left")
    return ds.with_df(df.drop(*own), places=places)


def unstack(ds: Dataset, crs: str | dict | None = None, **grid) -> Dataset:
    """``grid_index`` becomes ``yc`` and ``xc`` in projected metres; arguments override the grid mapping."""
    if ds.is_point():
        raise ValueError("points can't be unstacked")
    crs = resolve_crs(crs) if crs is not None else ds.crs
    g = (ds.grid or {}) | {k: v for k, v in grid.items() if v is not None}
    if crs is None:
        raise KeyError("crs")
    if missing := [k for k in _GRID_KEYS if k not in g]:
        raise KeyError(", ".join(missing))
    size = ds.df.select("grid_index").distinct().count()
    if size != g["nx"] * g["ny"]:
        raise ValueError(f"{size} cells aren't {g['nx']} x {g['ny']}")
    x_ll, y_ll = project_point(crs, g["lon_ll"], g["lat_ll"])
    df = ds.df.withColumn("yc", F.lit(y_ll) + F.expr(f"grid_index div {g['nx']}") * F.lit(float(g["dy"]))).withColumn("xc", F.lit(x_ll) + (F.col("grid_index") % g["nx"]) * F.lit(float(g["dx"])))
    if ds.places is not None and {"longitude", "latitude"} <= set(ds.places.columns):
        df = df.join(ds.places.select("grid_index", "longitude", "latitude"), "grid_index", "left")
    return ds.with_df(df.drop("grid_index"), places=None, crs=crs, grid=g)


def same_grid(a: Dataset, b: Dataset) -> bool:
    """Whether cells have the same numbers and places, within the tolerance."""
    pair = a.places.select("grid_index", F.col("longitude").alias("x"), F.col("latitude").alias("y")).join(b.places.select("grid_index", "longitude", "latitude"), "grid_index", "full")
    close = lambda p, q: F.abs(p - q) <= ATOL + RTOL * F.abs(q)
    ok = F.coalesce(close(F.col("x"), F.col("longitude")) & close(F.col("y"), F.col("latitude")), F.lit(False))
    return bool(pair.agg(F.bool_and(ok)).first()[0])


def align_pair(a: Dataset, b: Dataset, method: str = "bilinear", **options) -> tuple[Dataset, Dataset]:
    if a.is_grid() and b.is_grid():
        if not same_grid(a, b):
            raise NotImplementedError("the grids differ")
        return a, b
    if a.is_grid() and b.is_point():
        return interpolate_one(a, b, method, **options), b
    raise NotImplementedError(f"{a.properties.space} to {b.properties.space}")


def align_space(datasets: Dataset | Iterable[Dataset] | dict[str, Dataset], reference: Dataset, **options):
    """Each dataset on the reference's places; a single one comes back unwrapped."""
    if isinstance(datasets, Dataset):
        return align_pair(datasets, reference, **options)[0]
    sets = list(datasets.values() if isinstance(datasets, dict) else datasets)
    out = [align_pair(d, reference, **options)[0] for d in sets]
    return out[0] if len(out) == 1 else out


@dataclass(frozen=True)
class SpaceAccessor:
    ds: Dataset

    def is_grid(self) -> bool:
        return self.ds.is_grid()

    def is_point(self) -> bool:
        return self.ds.is_point()

    def add_crs(self, crs):
        return add_crs(self.ds, crs)

    def add_grid_mapping(self, grid):
        return add_grid_mapping(self.ds, grid)

    def add_xy(self, crs=None):
        return add_xy(self.ds, crs)

    def is_stacked(self) -> bool:
        return is_stacked(self.ds)

    def stack(self):
        return stack(self.ds)

    def unstack(self, crs=None, **grid):
        return unstack(self.ds, crs, **grid)

    def align_with(self, other: Dataset, **options):
        return align_pair(self.ds, other, **options)
