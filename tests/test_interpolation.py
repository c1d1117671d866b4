"""Interpolation against plain geometry."""

import importlib
import os
from datetime import datetime
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyverify import interpolate
from skyverify.model import Dataset, Properties, Space, Time
from skyverify.operators.interpolate import hull, triangle_at

module = importlib.import_module("skyverify.operators.interpolate")  # the package has a function of that name


def grid(spark, lat, lon, value=None, index=None):
    n = len(lat)
    index = np.arange(n) if index is None else index
    places = spark.createDataFrame(pd.DataFrame({"grid_index": index, "latitude": lat, "longitude": lon}))
    value = 2 * np.asarray(lat) + 3 * np.asarray(lon) if value is None else value
    df = spark.createDataFrame(pd.DataFrame({"valid_time": [datetime(2024, 1, 1)] * n, "grid_index": index, "v": value})).withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))
    return Dataset(df, Properties(Space.GRID, Time.OBSERVATION), places)


def points(spark, lat, lon):
    places = spark.createDataFrame(pd.DataFrame({"point_index": np.arange(len(lat)), "latitude": lat, "longitude": lon}))
    return Dataset(places.select("point_index", F.lit(None).cast("timestamp_ntz").alias("valid_time")), Properties(Space.POINT, Time.OBSERVATION), places)


def values(ds):
    return {r.point_index: r.v for r in ds.df.collect()}


def delaunay_of(xy):
    """All triangles with an empty circumcircle."""
    out = set()
    for t in combinations(range(len(xy)), 3):
        a, b, c = xy[list(t)]
        m = np.array([b - a, c - a]) * 2
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        u = np.linalg.solve(m, [(b - a) @ (b - a), (c - a) @ (c - a)])
        others = np.delete(np.arange(len(xy)), t)
        if (((xy[others] - a - u) ** 2).sum(axis=1) >= (u**2).sum() - 1e-9).all():
            out.add(t)
    return out


def test_triangles_are_those_of_all_empty_circles():
    rng = np.random.default_rng(0)
    xy = rng.random((40, 2))
    want = delaunay_of(xy)
    found = set()
    for q in rng.random((300, 2)):
        x, y = (xy - q).T
        got = triangle_at(x, y, x * x + y * y)
        if got:
            t = tuple(sorted(got[0]))
            assert t in want
            w = np.linalg.solve(np.array([xy[list(t), 0], xy[list(t), 1], np.ones(3)]), [*q, 1])
            assert (w >= -1e-9).all()
            found.add(t)
        else:
            corners = hull(*xy.T)
            d = np.roll(corners, -1, axis=0) - corners
            assert (d[:, 0] * (q[1] - corners[:, 1]) - d[:, 1] * (q[0] - corners[:, 0]) < 1e-9).any()
    assert len(found) > 40


@pytest.mark.parametrize("near", [0.6, 3.0, 100.0])
def test_delaunay_join_matches_the_triangulation(spark, near):
    rng = np.random.default_rng(1)
    xy, q = rng.random((45, 2)) * [4, 9] + [40, 5], rng.random((150, 2)) * [5, 10] + [39.5, 4.5]
    q = np.concatenate([q, xy[:5]])
    f = rng.random(45)
    got = values(interpolate(grid(spark, *xy.T, f), points(spark, *q.T), "delaunay", near=near))
    triangles = [list(t) for t in delaunay_of(xy)]
    inside = 0
    for k, p in enumerate(q):
        want = [w @ f[t] for t in triangles if ((w := np.linalg.solve(np.array([*xy[t].T, np.ones(3)]), [*p, 1])) >= -1e-9).all()]
        inside += bool(want)
        assert (got[k] is None) == (not want) and all(abs(x - got[k]) < 1e-6 for x in want)
    assert 60 < inside < 150


def test_delaunay_of_a_regular_grid_lines_and_no_cells(spark):
    lat, lon = (a.ravel() for a in np.meshgrid(np.arange(40.0, 46), np.arange(3.0, 11), indexing="ij"))
    q = np.array([[40, 3], [45, 10], [42.5, 3], [41, 5], [41.25, 5.75], [44.5, 9.5], [46, 3], [39.999, 4]])
    got = values(interpolate(grid(spark, lat, lon), points(spark, *q.T), "delaunay"))
    assert [got[k] is None for k in range(8)] == [False] * 6 + [True] * 2
    assert all(abs(got[k] - (2 * q[k, 0] + 3 * q[k, 1])) < 1e-9 for k in range(6))
    line = values(interpolate(grid(spark, np.arange(5.0), np.arange(5.0)), points(spark, [1.0], [1.0]), "delaunay"))
    assert line == {0: None}
    twice = np.r_[lat, lat[:4]], np.r_[lon, lon[:4]]
    assert abs(values(interpolate(grid(spark, *twice), points(spark, [41.3], [4.2]), "delaunay"))[0] - (2 * 41.3 + 3 * 4.2)) < 1e-9
    missing = 2 * lat + 3 * lon
    missing[9] = np.nan
    source = grid(spark, lat, lon, missing)
    source = source.with_df(source.df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))))
    at = lat[9], lon[9]
    assert values(interpolate(source, points(spark, [at[0] + 0.1, 44.2], [at[1] + 0.1, 8.1]), "delaunay"))[0] is None


def test_uneven_axes_and_nearest(spark):
    lat, lon = (a.ravel() for a in np.meshgrid([1.0, 2.0, 10.0], [5.0, 5.5, 90.0, 91.0], indexing="ij"))
    q = np.array([[1, 5], [10, 91], [3.0, 47.0], [9.9, 90.5], [10.0, 5.2], [0.9, 6], [5, 91.1]])
    got = values(interpolate(grid(spark, lat, lon), points(spark, *q.T)))
    assert all(abs(got[k] - (2 * q[k, 0] + 3 * q[k, 1])) < 1e-9 for k in range(5)) and got[5] is got[6] is None
    near = values(interpolate(grid(spark, lat, lon), points(spark, *q.T), "nearest"))
    assert near[2] == 2 * 2.0 + 3 * 5.5 and near[3] == 2 * 10 + 3 * 90.0 and near[5] is None
    with pytest.raises(ValueError):
        interpolate(grid(spark, lat[1:], lon[1:]), points(spark, *q.T))
    with pytest.raises(ValueError, match="from grid to point"):
        interpolate(points(spark, *q.T), points(spark, *q.T))
    with pytest.raises(ValueError):
        module.delaunay(grid(spark, lat, lon), points(spark, *q.T), method="cubic")


def test_weights_are_kept_for_the_same_places(spark, monkeypatch):
    calls = []
    monkeypatch.setitem(module._METHODS, "counted", lambda s, t: calls.append(1) or module._METHODS["bilinear"](s, t))
    lat, lon = (a.ravel() for a in np.meshgrid([1.0, 2.0], [5.0, 6.0, 7.0], indexing="ij"))
    to = points(spark, [1.5], [5.5])
    a, b = grid(spark, lat, lon), grid(spark, lat, lon, np.ones(6))
    out = interpolate([a, b], to, "counted")
    assert len(calls) == 1 and values(out[1]) == {0: 1.0}
    interpolate(grid(spark, lat + 1, lon), to, "counted")
    assert len(calls) == 2


@pytest.mark.slow
@pytest.mark.skipif(not os.environ.get("RUN_SLOW"), reason="RUN_SLOW isn't set")
def test_delaunay_of_a_million_cells(spark):
    n = 1000
    lat, lon = (a.ravel() for a in np.meshgrid(np.linspace(40, 50, n), np.linspace(0, 12, n), indexing="ij"))
    rng = np.random.default_rng(3)
    lat, lon = lat + rng.random(n * n) * 0.004, lon + rng.random(n * n) * 0.005
    q = rng.random((400, 2)) * [9.9, 11.9] + [40.05, 0.05]
    got = values(interpolate(grid(spark, lat, lon), points(spark, *q.T), "delaunay"))
    assert all(abs(got[k] - (2 * q[k, 0] + 3 * q[k, 1])) < 1e-8 for k in range(400))
