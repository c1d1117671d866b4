"""Grid to point interpolation: a weights table joined to the field and summed for each point.

Weights are found by joins on keys of place, so neither grids nor points have to fit anywhere.  They
are kept for the next dataset on the same grid and points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projections import project, project_point
from ..model import Dataset, Space

_METHODS: dict[str, Callable] = {}
#: Weights of earlier calls by method, options and what identifies grid and points; the oldest go first.
_KEPT: dict[tuple, tuple[DataFrame, int]] = {}
KEEP = 8


#: Space traits that a method goes from and to.
_TRAITS: dict[str, tuple[Space, Space]] = {}


def register_interpolator(name: str, source: Space = Space.GRID, target: Space = Space.POINT):
    """Register a function of (source, target, **options) that gives (``point_index, corner, grid_index, w``, corners for each point).

    ``source`` and ``target`` are the space traits of datasets that it takes.
    """

    def add(fn):
        _METHODS[name], _TRAITS[name] = fn, (source, target)
        return fn

    return add


def available_interpolations() -> list[str]:
    return sorted(_METHODS)


def _axis(points: DataFrame, cells: DataFrame, c: str, low: float, high: float, n: int) -> DataFrame:
    """``points`` with ``{c}_lo``, ``{c}_hi`` and ``{c}_share``: the nodes around each point and the upper one's weight, NULL outside.

    Intervals between nodes and points meet in buckets of equal width, one for each node.
    """
    width = (high - low) / n or 1.0
    bucket = lambda x: F.floor((x - F.lit(low)) / F.lit(width)).cast("long")
    above = F.lead(c).over(Window.orderBy(c))  # over one axis, as long as the grid is wide
    nodes = cells.select(c).distinct().select(F.col(c).alias("_lo"), (F.coalesce(above, F.col(c)) if n == 1 else above).alias("_hi")).where("_hi IS NOT NULL")
    nodes = nodes.select("_lo", "_hi", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))).alias("_b"))
    x = F.col(f"_p.{c}")
    inside = (x >= F.col("_lo")) & ((x < F.col("_hi")) | ((x == F.col("_hi")) & (F.col("_hi") == high)))
    met = points.withColumn("_b", bucket(F.col(c))).alias("_p").join(nodes.alias("_n"), (F.col("_p._b") == F.col("_n._b")) & inside, "left")
    share = F.when(F.col("_lo").isNull(), None).when(F.col("_lo") == F.col("_hi"), 0.0).otherwise((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return met.select(*[F.col(f"_p.{k}") for k in points.columns], F.coalesce("_lo", F.lit(low)).alias(f"{c}_lo"), F.coalesce("_hi", F.lit(low)).alias(f"{c}_hi"), share.alias(f"{c}_share"))


def _corners(points: DataFrame, x: tuple, y: tuple, method: str) -> DataFrame:
    """Rows for each point with places along x and y and the weight: four corners, or the nearest one."""
    (x0, x1, fx), (y0, y1, fy) = x, y
    if method == "nearest":  # halfway goes to the lower node
        fx, fy = (F.when(f <= 0.5, 0.0).when(f > 0.5, 1.0) for f in (fx, fy))
    corner = lambda k, i, j, w: F.struct(F.lit(k).alias("corner"), i.alias("ix"), j.alias("iy"), w.alias("w"))
    made = [corner(0, x0, y0, (1 - fx) * (1 - fy)), corner(1, x1, y0, fx * (1 - fy)), corner(2, x0, y1, (1 - fx) * fy), corner(3, x1, y1, fx * fy)]
    out = points.select("point_index", F.explode(F.array(*made)).alias("c")).select("point_index", "c.*")
    if method == "nearest":
        out = out.where((F.col("w") == 1.0) | (F.col("w").isNull() & (F.col("corner") == 0))).withColumn("corner", F.lit(0))
    return out


def _on_grid(source: Dataset, target: Dataset, method: str) -> tuple[DataFrame, int]:
    points, corners = target.places, 1 if method == "nearest" else 4
    if source.grid is None:
        cells = source.places.select("grid_index", "longitude", "latitude")
        sides = [F.countDistinct("longitude"), F.countDistinct("latitude"), F.count("*")]
        nx, ny, n, *ends = cells.agg(*sides, *[f(c) for c in ("longitude", "latitude") for f in (F.min, F.max)]).first()
        if n != nx * ny or not n:
            raise ValueError("the grid isn't regular in latitude and longitude, and has no grid mapping")
        at = _axis(_axis(points.select("point_index", "longitude", "latitude"), cells, "longitude", *ends[:2], nx), cells, "latitude", *ends[2:], ny)
        at = _corners(at, tuple(F.col(f"longitude_{k}") for k in ("lo", "hi", "share")), tuple(F.col(f"latitude_{k}") for k in ("lo", "hi", "share")), method)
        at = at.withColumnsRenamed({"ix": "longitude", "iy": "latitude"})
        return at.join(cells, ["longitude", "latitude"]).select("point_index", "corner", "grid_index", "w"), corners
    if source.crs is None:
        raise KeyError("crs")
    g = source.grid
    x_ll, y_ll = project_point(source.crs, g["lon_ll"], g["lat_ll"])
    x, y = project(source.crs, F.col("longitude"), F.col("latitude"))

    def along(v: Column, n: int, first: float, d: float) -> tuple[Column, Column, Column]:
        pos = (v - first) / d
        low = F.coalesce(F.least(F.greatest(F.floor(pos), F.lit(0)), F.lit(max(n - 2, 0))), F.lit(0))
        return low, F.least(low + 1, F.lit(n - 1)), F.when((pos < 0) | (pos > n - 1), None).otherwise(pos - low)

    at = _corners(points, along(x, g["nx"], x_ll, g["dx"]), along(y, g["ny"], y_ll, g["dy"]), method)
    return at.select("point_index", "corner", (F.col("iy") * g["nx"] + F.col("ix")).cast("long").alias("grid_index"), "w"), corners


@register_interpolator("bilinear")
def bilinear(source: Dataset, target: Dataset, method: str = "linear") -> tuple[DataFrame, int]:
    """Weights on a regular latitude-longitude grid, or on a projected grid that has a grid mapping.

    ``method`` is ``linear`` or ``nearest``.  A point outside the grid gets NULL weights.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    return _on_grid(source, target, method)


@register_interpolator("nearest")
def nearest(source: Dataset, target: Dataset) -> tuple[DataFrame, int]:
    """The nearest cell on the grids of ``bilinear``; halfway goes to the lower node."""
    return _on_grid(source, target, "nearest")


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counterclockwise; all points if they are on a line."""
    p = np.unique(np.stack([x, y], axis=1), axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def triangle_at(x: np.ndarray, y: np.ndarray, lift: np.ndarray) -> tuple[list[int], np.ndarray] | None:
    """The Delaunay triangle of the points around the origin, and its lifted plane (a, b, c); None if there is none.

    Lifted to a paraboloid, the triangulation is the lower hull, and the triangle around the origin
    is the highest plane there that stays under all points: a linear programme in three unknowns,
    solved by pivots from a large triangle that isn't there.
    """
    n = len(x)
    px, py = np.r_[x, -8.0, 8.0, 0.0], np.r_[y, -6.0, -6.0, 10.0]
    h = np.r_[lift, [1e7] * 3]
    basis, weight = [n, n + 1, n + 2], None
    for _ in range(40 + 4 * n):
        corner = np.array([px[basis], py[basis], np.ones(3)])
        if weight is None:
            weight = np.linalg.solve(corner, [0.0, 0.0, 1.0])
        plane = np.linalg.solve(corner.T, h[basis])
        under = h[:n] - (plane[0] * x + plane[1] * y + plane[2])
        k = int(under.argmin()) if n else 0
        if not n or under[k] >= -1e-13 * max(1.0, abs(plane[2])) or k in basis:
            return (basis, plane) if max(basis) < n else None
        share = np.linalg.solve(corner, [px[k], py[k], 1.0])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(share > 1e-14, weight / share, np.inf)
        out = int(ratio.argmin())
        weight = weight - ratio[out] * share
        weight[out] = ratio[out]
        basis[out] = k
    return None


_FOUND = "point_index bigint, corner int, grid_index bigint, w double"


def _locate(reach: float, spacing: float, center: tuple[float, float], last: bool):
    """For one point with the cells around it: three weights, or a row without a cell if a circumcircle leaves what was gathered."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        point, q = int(rows["point_index"].iloc[0]), np.array([rows["_qx"].iloc[0], rows["_qy"].iloc[0]])
        rows = rows.dropna(subset=["grid_index"]).sort_values("grid_index").drop_duplicates(["_x", "_y"])
        index = rows["grid_index"].to_numpy(np.int64)
        p = rows[["_x", "_y"]].to_numpy(float)
        inner = q + 1e-9 * (np.array(center) - q)  # off edges and corners
        x, y = ((p - inner) / reach).T if len(p) else (np.zeros(0), np.zeros(0))
        # cells of one circle: a small fixed lift for each chooses the same triangles everywhere
        mixed = (index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        lift = x * x + y * y + 1e-10 * (spacing / reach) ** 2 * mixed.astype(float) / 2.0**53
        found = triangle_at(x, y, lift)
        if found:
            basis, (a, b, c) = found
            radius = max(c + (a * a + b * b) / 4, 0.0) ** 0.5
            if last or max(abs(a), abs(b)) / 2 + radius <= 1.0:
                basis = sorted(basis, key=lambda k: index[k])
                w = np.linalg.solve(np.array([p[basis, 0] - q[0], p[basis, 1] - q[1], np.ones(3)]), [0.0, 0.0, 1.0])
                return pd.DataFrame({"point_index": point, "corner": range(3), "grid_index": index[basis], "w": np.where(np.abs(w) < 1e-12, 0.0, w)})
        return pd.DataFrame({"point_index": [point], "corner": [0], "grid_index": pd.array([None], "Int64"), "w": [None]})

    return run


@register_interpolator("delaunay")
def delaunay(source: Dataset, target: Dataset, method: str = "linear", near: float = 3.0) -> tuple[DataFrame, int]:
    """Barycentric weights in the Delaunay triangulation of the cells in (latitude, longitude) degrees.

    Only the triangles around points are made.  A point meets the cells within ``near`` mean spacings
    by keys of tiles; a triangle whose circumcircle stays within them is one of the whole
    triangulation.  Points without one go on with a wider reach.  A point outside the hull gets NULL
    weights; one on an edge takes the triangle towards the grid's middle.  The driver gets the
    corners of hulls only.
    """
    if method != "linear":
        raise ValueError(f"only linear is there, not {method!r}")
    if "grid_index" not in source.df.columns:
        raise ValueError("the grid must be stacked to grid_index")
    cells = source.places.select("grid_index", F.col("latitude").cast("double").alias("_x"), F.col("longitude").cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    points = target.places.select("point_index", F.col("latitude").cast("double").alias("_qx"), F.col("longitude").cast("double").alias("_qy"))
    n, least, x0, x1, y0, y1 = cells.agg(F.count("*"), F.min("grid_index"), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()

    def part_hull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = np.zeros((0, 2))
        for rows in batches:
            every = np.concatenate([now, rows[["_x", "_y"]].to_numpy(float)])
            now = hull(every[:, 0], every[:, 1])
        yield pd.DataFrame(now, columns=["_x", "_y"])

    none = points.select("point_index", F.lit(0).alias("corner"), F.lit(least).cast("long").alias("grid_index"), F.lit(None).cast("double").alias("w"))
    border = np.array([tuple(r) for r in cells.select("_x", "_y").mapInPandas(part_hull, "_x double, _y double").collect()]).reshape(-1, 2) if n else np.zeros((0, 2))
    corners = hull(border[:, 0], border[:, 1])
    if len(corners) < 3:
        return (none if n else none.limit(0)), 3
    center, spacing = tuple(corners.mean(axis=0)), (((x1 - x0) * (y1 - y0)) / n) ** 0.5 or 1.0

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = corners, np.roll(corners, -1, axis=0)
        slack = 1e-12 * max(abs(x1 - x0), abs(y1 - y0)) * np.hypot(*(b - a).T)
        for rows in batches:
            q = rows[["_qx", "_qy"]].to_numpy(float)
            inside = np.ones(len(q), bool)
            for k in range(len(a)):
                inside &= (b[k, 0] - a[k, 0]) * (q[:, 1] - a[k, 1]) - (b[k, 1] - a[k, 1]) * (q[:, 0] - a[k, 0]) >= -slack[k]
            yield rows[inside]

    todo = points.where("_qx IS NOT NULL AND _qy IS NOT NULL").mapInPandas(within, "point_index bigint, _qx double, _qy double").persist()
    span, reach, found = max(x1 - x0, y1 - y0), near * spacing, []
    while True:
        last = reach >= span
        tile = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")  # noqa: B023, E731
        around = lambda c: F.explode(F.sequence(tile(c) - 1, tile(c) + 1))  # noqa: B023, E731
        asked = todo.select("*", around("_qx").alias("_tx")).select("*", around("_qy").alias("_ty"))
        met = asked.join(cells.select("grid_index", "_x", "_y", tile("_x").alias("_tx"), tile("_y").alias("_ty")), ["_tx", "_ty"], "left")
        got = met.groupBy("point_index").applyInPandas(_locate(reach, spacing, center, last), _FOUND).persist()
        found.append(got.where("grid_index IS NOT NULL"))
        left = todo.join(got.where("grid_index IS NULL").select("point_index"), "point_index", "left_semi").persist()
        if last or left.isEmpty():
            break
        todo, reach = left, 4 * reach
    every = reduce(DataFrame.union, found)
    return every.union(none.join(every.select("point_index").distinct(), "point_index", "left_anti")), 3


def apply_weights(source: Dataset, weights: DataFrame, corners: int) -> DataFrame:
    """Weighted sums in corner order; NULL if any corner's value or weight is."""
    lead = [k for k in source.keys if k != "grid_index"]
    joined = source.df.join(weights, "grid_index")
    terms = {v: F.col(v) * F.col("w") for v in source.variables}
    parts = [F.max(F.when(F.col("corner") == k, t)).alias(f"{v}__{k}") for v, t in terms.items() for k in range(corners)]
    out = joined.groupBy(*lead, "point_index").agg(*parts)
    # adding NULL gives NULL, as a missing corner must
    return out.select(*lead, "point_index", *[reduce(lambda x, y: x + y, (F.col(f"`{v}__{k}`") for k in range(corners))).alias(v) for v in source.variables])


def _weights(source: Dataset, target: Dataset, method: str, options: dict) -> tuple[DataFrame, int]:
    """Weights, from an earlier call if grid and points are the same."""

    def mark(ds: Dataset, key: str) -> tuple:
        if ds.places is None:
            return ()
        row = F.xxhash64(F.col(key), F.col("longitude").cast("double"), F.col("latitude").cast("double"))
        return tuple(ds.places.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)"))).first())

    spark = source.df.sparkSession
    key = (spark.sparkContext.applicationId, method, repr(sorted(options.items())), repr((source.grid, source.crs)), mark(source, "grid_index"), mark(target, "point_index"))
    if key not in _KEPT:
        while len(_KEPT) >= KEEP:
            _KEPT.pop(next(iter(_KEPT)))[0].unpersist()
        weights, corners = _METHODS[method](source, target, **options)
        _KEPT[key] = weights.persist(), corners
    return _KEPT[key]


def interpolate_one(source: Dataset, target: Dataset, method: str = "bilinear", **options) -> Dataset:
    if method not in _METHODS:
        raise ValueError(f"unknown interpolation {method!r}; there are {', '.join(available_interpolations())}")
    given, wanted = (source.properties.space, target.properties.space), _TRAITS.get(method, (Space.GRID, Space.POINT))
    if given != wanted:
        raise ValueError(f"{method} goes from {wanted[0]} to {wanted[1]}, not from {given[0]} to {given[1]}")
    if source.space_key != "grid_index":
        raise ValueError("the grid must be stacked to grid_index")
    weights, corners = _weights(source, target, method, options)
    out = source.with_df(apply_weights(source, weights, corners), places=target.places, grid=None, crs=None)
    return out.with_space(Space.POINT)


def interpolate(source: Dataset | list | dict, target: Dataset, method: str = "bilinear", **options):
    """One dataset, a list or a dict of them, from a grid to the places of ``target``."""
    if isinstance(source, dict):
        return {k: interpolate_one(d, target, method, **options) for k, d in source.items()}
    if isinstance(source, list):
        return [interpolate_one(d, target, method, **options) for d in source]
    return interpolate_one(source, target, method, **options)
