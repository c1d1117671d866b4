"""Map projections as column expressions and as plain functions of numbers.

Forward formulas are those of Snyder, Map Projections: A Working Manual (USGS PP 1395); with
eccentricity 0 they are the spherical ones.  The orthographic one on an ellipsoid is EPSG's method 9840.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = SimpleNamespace(sin=math.sin, cos=math.cos, tan=math.tan, log=math.log, pow=math.pow, sqrt=math.sqrt, rad=math.radians, wrap=lambda x: (x + 180) % 360 - 180, seen=lambda c, v: v if c >= 0 else math.nan)
_SPARK = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, log=F.log, pow=F.pow, sqrt=F.sqrt, rad=F.radians, wrap=lambda x: F.pmod(x + 180, F.lit(360)) - 180, seen=lambda c, v: F.when(c >= 0, v))
_WGS84 = {"semimajor_axis": 6378137.0, "semiminor_axis": 6356752.314245179}

_SPHERE = {"semimajor_axis": 6371229.0, "semiminor_axis": 6371229.0}
#: Presets of two weather models on a sphere (fixed values).
PRESETS = {
    "cerra": {
        "projection": "lcc",
        "kws_globe": _SPHERE,
        "kws_projection": {"central_longitude": 8.0, "central_latitude": 50.0, "standard_parallels": [50.0, 50.0]},
        "kws_grid": {"lon_ll": -17.4859, "lat_ll": 20.2923, "lon_ur": 74.1051, "lat_ur": 63.7695, "dx": 5500.0, "dy": 5500.0, "nx": 1069, "ny": 1069},
    },
    "uwcw": {
        "projection": "lcc",
        "kws_globe": _SPHERE,
        "kws_projection": {"central_longitude": -1.96590281, "central_latitude": 55.5164337, "standard_parallels": [55.499996, 55.499996]},
        "kws_grid": {"lon_ll": -25.4470005, "lat_ll": 39.6389999, "lon_ur": 40.1508102, "lat_ur": 62.6713715, "dx": 2000.0, "dy": 2000.0, "nx": 1909, "ny": 1609},
    },
}
# the corners that uwcw states fit a central meridian of 8 degrees west, not the stated one
PRESETS["uwcw_consistent"] = PRESETS["uwcw"] | {"kws_projection": PRESETS["uwcw"]["kws_projection"] | {"central_longitude": -8.0}}


def load_presets(more: dict[str, dict]) -> None:
    """Add presets by lower-case name."""
    PRESETS.update({k.lower(): v for k, v in more.items()})


def create_crs(projection: str, kws_projection: dict | None = None, kws_globe: dict | None = None) -> dict:
    """A projection's definition.  Without a globe WGS84 is meant."""
    if projection not in ("lcc", "latlon", "PlateCarree", "Mercator", "Orthographic"):
        raise ValueError(f"unknown projection {projection!r}")
    return {"projection": projection, "kws_projection": dict(kws_projection or {}), "kws_globe": dict(kws_globe or _WGS84)}


def resolve_crs(crs: str | dict) -> dict:
    """A definition, or the preset of that name."""
    if isinstance(crs, str):
        if crs.lower() not in PRESETS:
            raise ValueError(f"unknown preset {crs!r}; there are {', '.join(sorted(PRESETS))}")
        crs = {k: v for k, v in PRESETS[crs.lower()].items() if k != "kws_grid"}
    return create_crs(crs["projection"], crs.get("kws_projection"), crs.get("kws_globe"))


def _project(m: SimpleNamespace, crs: dict, lon, lat):
    kind, p, globe = crs["projection"], crs["kws_projection"], crs["kws_globe"]
    a = float(globe.get("semimajor_axis", _WGS84["semimajor_axis"]))
    b = float(globe.get("semiminor_axis", a))
    e2 = 1 - (b / a) ** 2
    e = math.sqrt(max(e2, 0.0))
    lon0, lat0 = float(p.get("central_longitude", 0.0)), float(p.get("central_latitude", 0.0))
    if kind in ("latlon", "PlateCarree"):
        return m.wrap(lon - lon0), lat
    dlon, phi = m.rad(m.wrap(lon - lon0)), m.rad(lat)

    def t_of(o, f):
        s = o.sin(f)
        plain = o.tan(math.pi / 4 - f / 2)
        return plain / o.pow((1 - e * s) / (1 + e * s), e / 2) if e else plain

    if kind == "Mercator":
        return dlon * a, m.log(t_of(m, phi)) * -a
    if kind == "Orthographic":
        # what lies beyond the horizon has no place on the map
        c, s = math.cos(math.radians(lat0)), math.sin(math.radians(lat0))
        across, north = m.cos(phi) * m.cos(dlon), m.sin(phi)
        radius = m.pow(1 - north * north * e2, -0.5) * a if e else a
        y = (north * c - across * s) * radius
        if e:
            y = y + (s * a / math.sqrt(1 - e2 * s * s) - north * radius) * (e2 * c)
        front = north * s + across * c
        return m.seen(front, m.cos(phi) * m.sin(dlon) * radius), m.seen(front, y)

    def m_of(f):
        return math.cos(f) / math.sqrt(1 - e2 * math.sin(f) ** 2)

    ps = [math.radians(x) for x in p.get("standard_parallels", (33.0, 45.0))]
    p1, p2 = ps[0], ps[-1]
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m_of(p1)) - math.log(m_of(p2))) / (math.log(t_of(_PLAIN, p1)) - math.log(t_of(_PLAIN, p2)))
    f = m_of(p1) / (n * t_of(_PLAIN, p1) ** n)
    rho0 = a * f * t_of(_PLAIN, math.radians(lat0)) ** n
    rho = m.pow(t_of(m, phi), n) * (a * f)
    return rho * m.sin(dlon * n), rho0 - rho * m.cos(dlon * n)


def project(crs: dict, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Projected x and y as columns."""
    return _project(_SPARK, crs, lon, lat)


def project_point(crs: dict, lon: float, lat: float) -> tuple[float, float]:
    return _project(_PLAIN, crs, lon, lat)


def corner_gap(crs: dict, grid: dict) -> tuple[float, float]:
    """By how many cells the upper-right corner misses where nx and ny cells from the lower-left one lead."""
    (x0, y0), (x1, y1) = project_point(crs, grid["lon_ll"], grid["lat_ll"]), project_point(crs, grid["lon_ur"], grid["lat_ur"])
    return (x1 - x0) / grid["dx"] - (grid["nx"] - 1), (y1 - y0) / grid["dy"] - (grid["ny"] - 1)
