"""Registered queries of the alignment and verification engine, with DuckDB SQL for each.

``events`` stand in for station observations, ``orders`` for gridded values on the 25 nations as a
5 x 5 grid, ``supplier`` for points on it.  Means are of whole cents, so that both engines get the
same doubles; sums over many cells are cut at six digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import Dates, add_seconds
from ..functions.projections import create_crs, project
from ..model import Dataset, Properties, Space, Time
from ..operators import space_alignment as grids
from ..operators import time_alignment as times
from ..operators.interpolate import interpolate
from ..operators.mask import broadcast_nulls, masked_frame
from ..operators.transform import transform
from ..operators.verify import Metric, stacked_metrics
from ..sources.loaders import analysis_dataset, densify, run_dataset, station_places
from ..sources.sinks import modal_date, save_sets
from ..streaming import observation_means
from .runner import Runner

VARIABLES = ["value", "click", "view"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTE = """
WITH cents AS (
  SELECT date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS BIGINT)) AS valid_time, user_id AS point_index, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events),
obs AS (
  SELECT valid_time, point_index, sum(c) / count(*) / 100::DOUBLE AS value,
    sum(CASE WHEN event_type = 'click' THEN c END) / count(CASE WHEN event_type = 'click' THEN c END) / 100::DOUBLE AS click,
    sum(CASE WHEN event_type = 'view' THEN c END) / count(CASE WHEN event_type = 'view' THEN c END) / 100::DOUBLE AS view
  FROM cents GROUP BY ALL),
days AS (SELECT DISTINCT date_trunc('day', valid_time)::TIMESTAMP AS reference_time FROM obs),
fc1 AS (
  SELECT reference_time, lead_s, point_index, value, click, view
  FROM days CROSS JOIN (SELECT unnest([0, 21600, 43200, 64800, 86400])::BIGINT AS lead_s) JOIN obs ON obs.valid_time + INTERVAL 24 HOUR = reference_time + to_seconds(lead_s)),
fc2 AS (
  SELECT reference_time, lead_s, point_index, value, click, view
  FROM days CROSS JOIN (SELECT unnest([0, 43200, 86400, 129600])::BIGINT AS lead_s) JOIN obs ON obs.valid_time + INTERVAL 48 HOUR = reference_time + to_seconds(lead_s)
  WHERE reference_time >= TIMESTAMP '2024-01-03'),
o AS (SELECT min(valid_time) AS first, max(valid_time) AS last FROM obs)
"""
_FIELD = """
WITH prices AS (
  SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS valid_time, c_nationkey::BIGINT AS grid_index, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100::DOUBLE AS price
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
field AS (
  SELECT t.valid_time, g.grid_index, p.price FROM (SELECT DISTINCT valid_time FROM prices) t CROSS JOIN (SELECT DISTINCT grid_index FROM prices) g
  LEFT JOIN prices p ON p.valid_time = t.valid_time AND p.grid_index = g.grid_index),
points AS (SELECT s_suppkey AS point_index, 40 + ((s_suppkey * 37) % 401) / 100::DOUBLE AS latitude, ((s_suppkey * 61) % 401) / 100::DOUBLE AS longitude FROM supplier)
"""


def query(sql: str | None):
    """Register a function under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(df: DataFrame) -> DataFrame:
    """Timestamps as text, which reads the same in every engine."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t.startswith("timestamp")})


def cut6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def _cents(value: str) -> Column:
    return F.round(F.col(value) * 100).cast("long")


def _mean(keep: Column | None = None, cents: str = "c") -> Column:
    c = F.col(cents) if keep is None else F.when(keep, F.col(cents))
    return F.try_divide(F.sum(c), F.count(c)) / F.lit(100.0)


def floor_6h(ts: str) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.floor(F.hour(ts) / 6).cast("int") * 6)


def _stations(events: DataFrame) -> DataFrame:
    key = F.col("point_index")
    return events.select(F.col("user_id").alias("point_index")).distinct().select("point_index", (40 + (key * 37) % 401 / 100).alias("latitude"), ((key * 61) % 401 / 100).alias("longitude"))


def observations(spark: SparkSession, sf_dir: str) -> Dataset:
    """Six-hourly means of all events, of clicks and of views, by user."""
    e = table(spark, sf_dir, "events").select(floor_6h("ts").alias("valid_time"), F.col("user_id").alias("point_index"), "event_type", _cents("value").alias("c"))
    kind = F.col("event_type")
    df = e.groupBy("valid_time", "point_index").agg(_mean().alias("value"), _mean(kind == "click").alias("click"), _mean(kind == "view").alias("view"))
    return Dataset(df, Properties(Space.POINT, Time.OBSERVATION), _stations(table(spark, sf_dir, "events")))


def persistence(obs: Dataset, leads_h: list[int], back_h: int, since: str | None = None) -> Dataset:
    """For each day and lead, what was observed ``back_h`` hours before the valid time."""
    days = obs.df.select(F.date_trunc("DAY", "valid_time").cast("timestamp_ntz").alias("reference_time")).distinct()
    if since:
        days = days.where(F.col("reference_time") >= F.lit(since).cast("timestamp_ntz"))
    leads = F.explode(F.array(*[F.lit(3600 * h).cast("long") for h in leads_h])).alias("lead_s")
    df = obs.df.select("*", leads).withColumn("reference_time", add_seconds(F.col("valid_time"), F.lit(3600 * back_h) - F.col("lead_s")))
    df = df.join(F.broadcast(days), "reference_time", "left_semi").select("reference_time", "lead_s", "point_index", *VARIABLES)  # days only
    return Dataset(df, Properties(Space.POINT, Time.FORECAST), obs.places)


def three(spark: SparkSession, sf_dir: str) -> dict[str, Dataset]:
    obs = observations(spark, sf_dir)
    return {"day": persistence(obs, [0, 6, 12, 18, 24], 24), "two_days": persistence(obs, [0, 12, 24, 36], 48, "2024-01-03"), "obs": obs}


def field(spark: SparkSession, sf_dir: str, jitter: bool = False) -> Dataset:
    """Monthly mean order prices on the 5 x 5 grid, every month for every cell."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.date_trunc("MONTH", "o_orderdate").cast("timestamp_ntz").alias("valid_time"), F.col("c_nationkey").cast("long").alias("grid_index"), _cents("o_totalprice").alias("c"))
    df = densify(o.groupBy("valid_time", "grid_index").agg(_mean().alias("price")), "grid_index")
    return Dataset(df, Properties(Space.GRID, Time.OBSERVATION), grid_places(spark, sf_dir, jitter))


def grid_places(spark: SparkSession, sf_dir: str, jitter: bool = False) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    lat, lon = 40.0 + F.floor(k / 5), (k % 5).cast("double")
    if jitter:
        lat, lon = lat + ((k * 7919) % 97 / 97.0 - 0.5) * 0.4, lon + ((k * 6101) % 89 / 89.0 - 0.5) * 0.4
    return table(spark, sf_dir, "nation").select(k.alias("grid_index"), lat.alias("latitude"), lon.alias("longitude"))


def suppliers(spark: SparkSession, sf_dir: str) -> Dataset:
    k = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(k.alias("point_index"), (40 + (k * 37) % 401 / 100).alias("latitude"), ((k * 61) % 401 / 100).alias("longitude"))
    return Dataset(places.select("point_index", F.lit(None).cast("timestamp_ntz").alias("valid_time")), Properties(Space.POINT, Time.OBSERVATION), places)


# --- sources ---------------------------------------------------------------------------------


@query(_CTE + "SELECT CAST(t.valid_time AS VARCHAR) AS valid_time, p.point_index, value, click, view FROM (SELECT DISTINCT valid_time FROM obs) t CROSS JOIN (SELECT DISTINCT point_index FROM obs) p LEFT JOIN obs USING (valid_time, point_index)")
def obs_6h_dense(spark, sf_dir):
    return shown(densify(observations(spark, sf_dir).df, "point_index"))


@query("""
SELECT CAST(row_number() OVER (ORDER BY c_nationkey) - 1 AS BIGINT) AS point_index, c_nationkey AS code, min((c_custkey * 37) % 401 / 100::DOUBLE) AS latitude, min((c_custkey * 61) % 401 / 100::DOUBLE) AS longitude, min(c_acctbal) AS elevation
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey""")
def station_table(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return station_places(c.select(F.col("c_nationkey").alias("SID"), (k * 37 % 401 / 100).alias("lat"), (k * 61 % 401 / 100).alias("lon"), F.col("c_acctbal").alias("elev")))


@query("""
WITH long AS (
  SELECT date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS BIGINT)) AS valid_time, event_type, user_id AS grid_index, sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100::DOUBLE AS data
  FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT CAST(valid_time AS VARCHAR) AS valid_time, grid_index, max(CASE WHEN event_type = 'click' THEN data END) AS click, max(CASE WHEN event_type = 'signup' THEN data END) AS signup, max(CASE WHEN event_type = 'view' THEN data END) AS view
FROM long WHERE event_type IN ('click', 'signup', 'view') GROUP BY ALL""")
def pivot_variables(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(floor_6h("ts").alias("dates"), F.col("event_type").alias("variable"), (F.col("event_id") % 2).cast("int").alias("ensemble"), F.col("user_id").alias("cell"), _cents("value").alias("c"))
    long = e.groupBy("dates", "variable", "ensemble", "cell").agg(_mean().alias("data")).withColumns({"longitudes": F.lit(0.0), "latitudes": F.lit(0.0)})
    forcing = long.withColumn("variable", F.lit("insolation"))
    return shown(analysis_dataset(long.unionByName(forcing), ["click", "signup", "view"]).df)


@query("""
SELECT CAST(min(l_shipdate) OVER w AS VARCHAR) AS reference_time, CAST(epoch(l_shipdate) - epoch(min(l_shipdate) OVER w) AS BIGINT) AS lead_s, CAST(l_linenumber AS BIGINT) AS grid_index, l_quantity
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def run_lead_from_files(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("time"), F.col("l_linenumber").alias("values"), "l_quantity")
    return shown(run_dataset(steps, "l_orderkey").df)


@query("""
SELECT CAST(r AS VARCHAR) AS reference_time, l AS lead_s, CAST(r + to_seconds(l) AS VARCHAR) AS valid_time
FROM (SELECT unnest(generate_series(TIMESTAMP '2020-02-01', TIMESTAMP '2020-03-01', INTERVAL 24 HOUR)) AS r) CROSS JOIN (SELECT unnest(generate_series(0, 518400, 21600)) AS l)""")
def reference_time_axis(spark, sf_dir):
    return shown(Dates("2020-02-01T00:00:00", "2020-03-01T00:00:00", "24h", "144h", "6h").axis(spark))


# --- derived columns -------------------------------------------------------------------------


@query(_CTE + "SELECT CAST(reference_time AS VARCHAR) AS reference_time, lead_s, point_index, value, click, view, CAST(reference_time + to_seconds(lead_s) AS VARCHAR) AS valid_time FROM fc1")
def add_valid_time(spark, sf_dir):
    return shown(three(spark, sf_dir)["day"].time.add_valid_time().df)


@query(_CTE + "SELECT CAST(valid_time AS VARCHAR) AS valid_time, point_index, value, click AS clicks, view AS views FROM obs")
def rename_variables(spark, sf_dir):
    return shown(transform("rename", observations(spark, sf_dir), {"clicks": ["tap", "click"], "views": "view", "absent": ["none"]}).df)


def _balances(spark, sf_dir) -> Dataset:
    c = table(spark, sf_dir, "customer")
    return Dataset(c.select(F.lit("2024-01-01").cast("timestamp_ntz").alias("valid_time"), F.col("c_custkey").alias("point_index"), F.col("c_acctbal").alias("t2m")), Properties(Space.POINT, Time.OBSERVATION))


@query("SELECT c_custkey AS point_index, c_acctbal - 273.15::DOUBLE AS t2m FROM customer")
def kelvin_to_celsius(spark, sf_dir):
    return transform("kelvin_to_celsius", _balances(spark, sf_dir), "t2m").df.drop("valid_time")


@query("SELECT c_custkey AS point_index, c_acctbal + 273.15::DOUBLE AS t2m FROM customer")
def celsius_to_kelvin(spark, sf_dir):
    return transform("kelvin_to_celsius", _balances(spark, sf_dir), ["t2m"], inverse=True).df.drop("valid_time")


def _winds(spark, sf_dir) -> Dataset:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("valid_time"), F.col("l_orderkey").alias("point_index"), F.col("l_linenumber").alias("member"), F.col("l_quantity").alias("u"), F.col("l_discount").alias("v"))
    return Dataset(df, Properties(Space.POINT, Time.OBSERVATION))


@query("SELECT l_orderkey AS point_index, l_linenumber AS member, sqrt(l_quantity * l_quantity + l_discount * l_discount) AS speed FROM lineitem")
def uv_to_speed(spark, sf_dir):
    return transform("uv_to_speed", _winds(spark, sf_dir), "u", "v", "speed").df.select("point_index", "member", "speed")


@query("SELECT l_orderkey AS point_index, l_linenumber AS member, l_discount * 100::DOUBLE / l_quantity AS share FROM lineitem")
def external_function(spark, sf_dir):
    return transform("external", _winds(spark, sf_dir), func_path="skyverify.functions.derived.ratio", inputs={"part": "v", "whole": "u"}, output="share", scale=100.0).df.select("point_index", "member", "share")


# --- alignment in time -----------------------------------------------------------------------


def _labelled(sets: dict[str, DataFrame]) -> DataFrame:
    out = None
    for k, df in sets.items():
        df = shown(df).select(F.lit(k).alias("model"), "*")
        out = df if out is None else out.unionByName(df)
    return out


_OUTER = """
runs AS (SELECT DISTINCT reference_time FROM fc1 INTERSECT SELECT DISTINCT reference_time FROM fc2),
leads AS (SELECT DISTINCT lead_s FROM fc1 UNION SELECT DISTINCT lead_s FROM fc2),
axis AS (SELECT reference_time, lead_s, reference_time + to_seconds(lead_s) AS valid_time FROM runs CROSS JOIN leads)
"""


def _outer_sql(name: str, frame: str) -> str:
    return f"SELECT '{name}' AS model, CAST(a.reference_time AS VARCHAR) AS reference_time, a.lead_s, p.point_index, value, click, view, CAST(a.valid_time AS VARCHAR) AS valid_time FROM axis a CROSS JOIN (SELECT DISTINCT point_index FROM {frame}) p LEFT JOIN {frame} f ON f.reference_time = a.reference_time AND f.lead_s = a.lead_s AND f.point_index = p.point_index"


@query(_CTE + "," + _OUTER + _outer_sql("day", "fc1") + " UNION ALL " + _outer_sql("two_days", "fc2"))
def align_fc_fc_outer(spark, sf_dir):
    d = three(spark, sf_dir)
    a, b = d["day"].time.align_with(d["two_days"])
    return _labelled({"day": a.df, "two_days": b.df})


_INNER = "SELECT '{0}' AS model, CAST(reference_time AS VARCHAR) AS reference_time, lead_s, point_index, value, click, view FROM {1} WHERE reference_time IN (SELECT reference_time FROM {2}) AND lead_s IN (SELECT lead_s FROM {2})"


@query(_CTE + _INNER.format("day", "fc1", "fc2") + " UNION ALL " + _INNER.format("two_days", "fc2", "fc1"))
def align_fc_fc_inner(spark, sf_dir):
    d = three(spark, sf_dir)
    a, b = d["day"].time.align_with(d["two_days"], only_common=True)
    return _labelled({"day": a.df, "two_days": b.df})


_STITCHED = """
SELECT 'fc' AS model, CAST(t.valid_time AS VARCHAR) AS valid_time, p.point_index, value, click, view FROM alltimes t CROSS JOIN (SELECT DISTINCT point_index FROM series) p LEFT JOIN series s ON s.valid_time = t.valid_time AND s.point_index = p.point_index
UNION ALL
SELECT 'obs' AS model, CAST(t.valid_time AS VARCHAR) AS valid_time, p.point_index, value, click, view FROM alltimes t CROSS JOIN (SELECT DISTINCT point_index FROM obs) p LEFT JOIN obs s ON s.valid_time = t.valid_time AND s.point_index = p.point_index"""


@query(_CTE + ", series AS (SELECT reference_time + to_seconds(lead_s) AS valid_time, * FROM fc1 WHERE lead_s < 86400), alltimes AS (SELECT valid_time FROM series UNION SELECT valid_time FROM obs)" + _STITCHED)
def align_fc_obs_startmin(spark, sf_dir):
    d = three(spark, sf_dir)
    a, b = d["day"].time.align_with(d["obs"])
    return _labelled({"fc": a.df.select("valid_time", "point_index", *VARIABLES), "obs": b.df.select("valid_time", "point_index", *VARIABLES)})


@query(
    _CTE
    + """, span AS (SELECT min(reference_time) AS a, max(reference_time) AS b FROM fc1),
series AS (
  SELECT reference_time + to_seconds(lead_s) AS valid_time, point_index, value, click, view FROM fc1, span WHERE reference_time < b AND (epoch(reference_time) - epoch(a)) % 86400 = 0
  QUALIFY row_number() OVER (PARTITION BY reference_time + to_seconds(lead_s), point_index ORDER BY lead_s) = 1),
alltimes AS (SELECT valid_time FROM series UNION SELECT valid_time FROM obs)"""
    + _STITCHED
)
def align_fc_obs_startmax(spark, sf_dir):
    d = three(spark, sf_dir)
    a, b = d["day"].time.align_with(d["obs"], lead_time="start-max")
    return _labelled({"fc": a.df.select("valid_time", "point_index", *VARIABLES), "obs": b.df.select("valid_time", "point_index", *VARIABLES)})


def _two_observations(spark, sf_dir) -> tuple[Dataset, Dataset]:
    obs = observations(spark, sf_dir)
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return obs.with_df(obs.df.where(F.col("valid_time") < day("2024-01-20")).drop("view")), obs.with_df(obs.df.where(F.col("valid_time") >= day("2024-01-10")).drop("view"))


_TWO = ", a AS (SELECT * EXCLUDE (view) FROM obs WHERE valid_time < TIMESTAMP '2024-01-20'), b AS (SELECT * EXCLUDE (view) FROM obs WHERE valid_time >= TIMESTAMP '2024-01-10')"
_ONE_OUTER = "SELECT '{0}' AS model, CAST(t.valid_time AS VARCHAR) AS valid_time, p.point_index, value, click FROM (SELECT valid_time FROM a UNION SELECT valid_time FROM b) t CROSS JOIN (SELECT DISTINCT point_index FROM {0}) p LEFT JOIN {0} s ON s.valid_time = t.valid_time AND s.point_index = p.point_index"


@query(_CTE + _TWO + _ONE_OUTER.format("a") + " UNION ALL " + _ONE_OUTER.format("b"))
def align_obs_obs_outer(spark, sf_dir):
    a, b = times.align_pair(*_two_observations(spark, sf_dir))
    return _labelled({"a": a.df, "b": b.df})


_ONE_INNER = "SELECT '{0}' AS model, CAST(valid_time AS VARCHAR) AS valid_time, point_index, value, click FROM {0} WHERE valid_time IN (SELECT valid_time FROM {1})"


@query(_CTE + _TWO + _ONE_INNER.format("a", "b") + " UNION ALL " + _ONE_INNER.format("b", "a"))
def align_obs_obs_inner(spark, sf_dir):
    a, b = times.align_pair(*_two_observations(spark, sf_dir), only_common=True)
    return _labelled({"a": a.df, "b": b.df})


_COVERED = ", cov AS (SELECT DISTINCT reference_time FROM fc1, o WHERE reference_time >= first AND reference_time + to_seconds((SELECT max(lead_s) FROM fc1)) <= last), leads AS (SELECT DISTINCT lead_s FROM fc1)"


@query(
    _CTE
    + _COVERED
    + """
SELECT CAST(r.reference_time AS VARCHAR) AS reference_time, l.lead_s, p.point_index, value, click, view, CAST(r.reference_time + to_seconds(l.lead_s) AS VARCHAR) AS valid_time
FROM (SELECT DISTINCT reference_time FROM fc1) r CROSS JOIN leads l CROSS JOIN (SELECT DISTINCT point_index FROM obs JOIN (SELECT reference_time + to_seconds(lead_s) AS vt FROM cov CROSS JOIN leads) ON vt = valid_time) p
LEFT JOIN obs ON obs.valid_time = r.reference_time + to_seconds(l.lead_s) AND obs.point_index = p.point_index AND r.reference_time IN (SELECT reference_time FROM cov)"""
)
def align_obs_fc(spark, sf_dir):
    d = three(spark, sf_dir)
    return shown(d["obs"].time.align_with(d["day"])[0].df)


@query(
    _CTE
    + _COVERED
    + """
SELECT 'obs' AS model, CAST(reference_time AS VARCHAR) AS reference_time, lead_s, point_index, value, click, view FROM cov CROSS JOIN leads JOIN obs ON valid_time = reference_time + to_seconds(lead_s)
UNION ALL SELECT 'fc', CAST(reference_time AS VARCHAR), lead_s, point_index, value, click, view FROM fc1 WHERE reference_time IN (SELECT reference_time FROM cov)"""
)
def align_obs_fc_common(spark, sf_dir):
    d = three(spark, sf_dir)
    a, b = d["obs"].time.align_with(d["day"], only_common=True)
    cols = ["reference_time", "lead_s", "point_index", *VARIABLES]
    return _labelled({"obs": a.df.select(*cols), "fc": b.df.select(*cols)})


_THREE = (
    ","
    + _OUTER
    + """, cov AS (SELECT reference_time FROM runs, o WHERE reference_time >= first AND reference_time + to_seconds((SELECT max(lead_s) FROM leads)) <= last),
look AS (SELECT a.reference_time, a.lead_s, obs.point_index, value, click, view FROM axis a JOIN obs ON obs.valid_time = a.valid_time WHERE reference_time IN (SELECT reference_time FROM cov))
"""
)


@query(_CTE + _THREE + _outer_sql("day", "fc1") + " UNION ALL " + _outer_sql("two_days", "fc2") + " UNION ALL " + _outer_sql("obs", "look"))
def align_time_three(spark, sf_dir):
    d = three(spark, sf_dir)
    return _labelled({k: x.df for k, x in zip(d, times.align_time(d), strict=True)})


# --- grids -----------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT n_nationkey AS k, 40::DOUBLE + n_nationkey // 5 AS lat, (n_nationkey % 5)::DOUBLE AS lon FROM nation), s AS (SELECT unnest([0, 0.0001, 0.001])::DOUBLE AS shift)
SELECT shift, bool_and(abs(lat - (lat + shift)) <= 1e-4::DOUBLE + 1e-5::DOUBLE * abs(lat + shift) AND abs(lon - (lon + shift)) <= 1e-4::DOUBLE + 1e-5::DOUBLE * abs(lon + shift)) AS same FROM g CROSS JOIN s GROUP BY shift""")
def grid_equal_tolerance(spark, sf_dir):
    base = field(spark, sf_dir)
    shifts = (0.0, 0.0001, 0.001)
    moved = [base.with_df(base.df, places=base.places.withColumns({"latitude": F.col("latitude") + s, "longitude": F.col("longitude") + s})) for s in shifts]
    return spark.createDataFrame([(s, grids.same_grid(base, m)) for s, m in zip(shifts, moved, strict=True)], "shift double, same boolean")


@query("SELECT n_nationkey::BIGINT AS grid_index, n_regionkey AS region FROM nation")
def stack_grid(spark, sf_dir):
    k = F.col("n_nationkey")
    df = table(spark, sf_dir, "nation").select(F.lit("2024-01-01").cast("timestamp_ntz").alias("valid_time"), (F.floor(k / 5) * 1000.0).alias("yc"), (k % 5 * 1000.0).alias("xc"), F.col("n_regionkey").alias("region"))
    return Dataset(df, Properties(Space.GRID, Time.OBSERVATION)).space.stack().df.select("grid_index", "region")


@query("SELECT n_regionkey AS region, 40::DOUBLE + (n_nationkey // 5) * 2::DOUBLE AS yc, 3::DOUBLE + (n_nationkey % 5) * 0.5::DOUBLE AS xc FROM nation")
def unstack_grid(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(F.lit("2024-01-01").cast("timestamp_ntz").alias("valid_time"), F.col("n_nationkey").cast("long").alias("grid_index"), F.col("n_regionkey").alias("region"))
    ds = Dataset(df, Properties(Space.GRID, Time.OBSERVATION), grid_places(spark, sf_dir), crs=create_crs("PlateCarree"))
    return ds.space.unstack(nx=5, ny=5, lon_ll=3.0, lat_ll=40.0, dx=0.5, dy=2.0).df.select("region", "yc", "xc")


_R = 6371229.0
_SPHERE = {"semimajor_axis": _R, "semiminor_axis": _R}
_LCC = create_crs("lcc", {"central_longitude": 8.0, "central_latitude": 50.0, "standard_parallels": [50.0, 50.0]}, _SPHERE)
_LCC_SQL = f"""
n AS (SELECT sin(radians(50)) AS n), f AS (SELECT n, cos(radians(50)) * pow(tan(pi() / 4 + radians(50) / 2), n) / n AS f FROM n),
lcc AS (SELECT point_index, {_R} * f / pow(tan(pi() / 4 + radians(latitude) / 2), n) AS rho, {_R} * f / pow(tan(pi() / 4 + radians(50) / 2), n) AS rho0, n * radians(longitude - 8) AS theta FROM points, f),
xy AS (SELECT point_index, rho * sin(theta) AS x, rho0 - rho * cos(theta) AS y FROM lcc)
"""


def _projected(spark, sf_dir, crs) -> DataFrame:
    x, y = project(crs, F.col("longitude"), F.col("latitude"))
    mm = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return suppliers(spark, sf_dir).places.select("point_index", mm(x).alias("xc"), mm(y).alias("yc"))


@query(_FIELD + "," + _LCC_SQL + "SELECT point_index, floor(x * 1000 + 0.5) / 1000 AS xc, floor(y * 1000 + 0.5) / 1000 AS yc FROM xy")
def project_lcc(spark, sf_dir):
    return _projected(spark, sf_dir, _LCC)


@query(_FIELD + f"SELECT point_index, floor(radians(longitude - 10) * {_R} * 1000 + 0.5) / 1000 AS xc, floor(ln(tan(pi() / 4 + radians(latitude) / 2)) * {_R} * 1000 + 0.5) / 1000 AS yc FROM points")
def project_mercator(spark, sf_dir):
    return _projected(spark, sf_dir, create_crs("Mercator", {"central_longitude": 10.0}, _SPHERE))


@query(_FIELD + f"SELECT point_index, floor(cos(radians(latitude)) * sin(radians(longitude - 5)) * {_R} * 1000 + 0.5) / 1000 AS xc, floor((cos(radians(45)) * sin(radians(latitude)) - sin(radians(45)) * cos(radians(latitude)) * cos(radians(longitude - 5))) * {_R} * 1000 + 0.5) / 1000 AS yc FROM points")
def project_orthographic(spark, sf_dir):
    return _projected(spark, sf_dir, create_crs("Orthographic", {"central_longitude": 5.0, "central_latitude": 45.0}, _SPHERE))


# --- interpolation ---------------------------------------------------------------------------

_CELL_SQL = """
cell AS (SELECT point_index, least(floor({x}), 3)::BIGINT AS ix, least(floor({y}), 3)::BIGINT AS iy, {x} AS x, {y} AS y FROM {frame} WHERE {x} BETWEEN 0 AND 4 AND {y} BETWEEN 0 AND 4),
part AS (SELECT *, x - ix AS fx, y - iy AS fy FROM cell)
"""
_BILINEAR_SQL = """
SELECT CAST(a.valid_time AS VARCHAR) AS valid_time, q.point_index, {v} AS price
FROM {frame} q CROSS JOIN (SELECT DISTINCT valid_time FROM field) a LEFT JOIN part p ON p.point_index = q.point_index
LEFT JOIN field c0 ON c0.valid_time = a.valid_time AND c0.grid_index = iy * 5 + ix LEFT JOIN field c1 ON c1.valid_time = a.valid_time AND c1.grid_index = iy * 5 + ix + 1
LEFT JOIN field c2 ON c2.valid_time = a.valid_time AND c2.grid_index = iy * 5 + ix + 5 LEFT JOIN field c3 ON c3.valid_time = a.valid_time AND c3.grid_index = iy * 5 + ix + 6"""
_SUM = "c0.price * ((1 - fx) * (1 - fy)) + c1.price * (fx * (1 - fy)) + c2.price * ((1 - fx) * fy) + c3.price * (fx * fy)"


@query(_FIELD + "," + _CELL_SQL.format(x="longitude", y="(latitude - 40)", frame="points") + _BILINEAR_SQL.format(v=f"floor(({_SUM}) * 100 + 0.5) / 100", frame="points"))
def interp_bilinear(spark, sf_dir):
    out = interpolate(field(spark, sf_dir), suppliers(spark, sf_dir)).df
    return shown(out.withColumn("price", F.floor(F.col("price") * 100 + 0.5) / 100))


@query(_FIELD + "," + _CELL_SQL.format(x="longitude", y="(latitude - 40)", frame="points") + _BILINEAR_SQL.format(v="CASE WHEN fx <= 0.5 AND fy <= 0.5 THEN c0.price WHEN fx > 0.5 AND fy <= 0.5 THEN c1.price WHEN fx <= 0.5 THEN c2.price ELSE c3.price END", frame="points"))
def interp_nearest(spark, sf_dir):
    return shown(interpolate(field(spark, sf_dir), suppliers(spark, sf_dir), "nearest").df)


_D = 90_000.0
_PROJECTED = _FIELD + "," + _LCC_SQL + """,
origin AS (
  SELECT {R} * f / pow(tan(pi() / 4 + radians(40) / 2), n) * sin(n * radians(0 - 8)) AS x0,
    {R} * f / pow(tan(pi() / 4 + radians(50) / 2), n) - {R} * f / pow(tan(pi() / 4 + radians(40) / 2), n) * cos(n * radians(0 - 8)) AS y0 FROM f),
rel AS (SELECT point_index, (x - x0) / {D} AS gx, (y - y0) / {D} AS gy FROM xy, origin),
""".replace("{R}", str(_R)).replace("{D}", str(_D)) + _CELL_SQL.format(x="gx", y="gy", frame="rel") + _BILINEAR_SQL.format(v=f"floor(({_SUM}) * 100 + 0.5) / 100", frame="rel")


@query(_PROJECTED)
def interp_projected(spark, sf_dir):
    source = field(spark, sf_dir)
    source = source.with_df(source.df, crs=_LCC, grid={"nx": 5, "ny": 5, "dx": _D, "dy": _D, "lon_ll": 0.0, "lat_ll": 40.0})
    out = interpolate(source, suppliers(spark, sf_dir)).df
    return shown(out.withColumn("price", F.floor(F.col("price") * 100 + 0.5) / 100))


@query(
    _FIELD
    + """, src AS (SELECT n_nationkey::BIGINT AS k, 40::DOUBLE + n_nationkey // 5 + ((n_nationkey * 7919) % 97 / 97::DOUBLE - 0.5::DOUBLE) * 0.4::DOUBLE AS y, n_nationkey % 5 + ((n_nationkey * 6101) % 89 / 89::DOUBLE - 0.5::DOUBLE) * 0.4::DOUBLE AS x FROM nation),
tri AS (SELECT a.k AS a, b.k AS b, c.k AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS area FROM src a JOIN src b ON a.k < b.k JOIN src c ON b.k < c.k),
del AS (
  SELECT * FROM tri t WHERE abs(area) > 1e-12 AND NOT EXISTS (
    SELECT 1 FROM src d WHERE d.k NOT IN (t.a, t.b, t.c) AND sign(area) * (
      (ax - d.x) * ((by_ - d.y) * ((cx - d.x) ** 2 + (cy - d.y) ** 2) - (cy - d.y) * ((bx - d.x) ** 2 + (by_ - d.y) ** 2))
      - (ay - d.y) * ((bx - d.x) * ((cx - d.x) ** 2 + (cy - d.y) ** 2) - (cx - d.x) * ((bx - d.x) ** 2 + (by_ - d.y) ** 2))
      + ((ax - d.x) ** 2 + (ay - d.y) ** 2) * ((bx - d.x) * (cy - d.y) - (cx - d.x) * (by_ - d.y))) > 0)),
bary AS (
  SELECT point_index, a, b, c, ((by_ - cy) * (longitude - cx) + (cx - bx) * (latitude - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wa,
    ((cy - ay) * (longitude - cx) + (ax - cx) * (latitude - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wb FROM points, del),
hit AS (SELECT * FROM bary WHERE wa >= -1e-12 AND wb >= -1e-12 AND 1 - wa - wb >= -1e-12 QUALIFY row_number() OVER (PARTITION BY point_index ORDER BY a, b, c) = 1)
SELECT CAST(t.valid_time AS VARCHAR) AS valid_time, q.point_index, floor((fa.price * wa + fb.price * wb + fc.price * (1 - wa - wb)) * 100 + 0.5) / 100 AS price
FROM points q CROSS JOIN (SELECT DISTINCT valid_time FROM field) t LEFT JOIN hit h ON h.point_index = q.point_index
LEFT JOIN field fa ON fa.valid_time = t.valid_time AND fa.grid_index = a LEFT JOIN field fb ON fb.valid_time = t.valid_time AND fb.grid_index = b LEFT JOIN field fc ON fc.valid_time = t.valid_time AND fc.grid_index = c"""
)
def interp_delaunay(spark, sf_dir):
    out = interpolate(field(spark, sf_dir, jitter=True), suppliers(spark, sf_dir), "delaunay").df
    return shown(out.withColumn("price", F.floor(F.col("price") * 100 + 0.5) / 100))


# --- missing values and metrics --------------------------------------------------------------


def _masked_sql(name: str) -> str:
    cols = ", ".join(f"CASE WHEN NOT max({v} IS NULL) OVER w THEN {v} END AS {v}" for v in VARIABLES)
    return f"SELECT * FROM (SELECT model, CAST(reference_time AS VARCHAR) AS reference_time, lead_s, point_index, {cols}, CAST(reference_time + to_seconds(lead_s) AS VARCHAR) AS valid_time FROM {name} WINDOW w AS (PARTITION BY reference_time, lead_s, point_index))"


_ALL_SQL = ", aligned AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, a.reference_time, a.lead_s, p.point_index, value, click, view FROM axis a CROSS JOIN (SELECT DISTINCT point_index FROM {f}) p LEFT JOIN {f} f ON f.reference_time = a.reference_time AND f.lead_s = a.lead_s AND f.point_index = p.point_index" for m, f in (("day", "fc1"), ("two_days", "fc2"), ("obs", "look"))
) + ")"


def aligned(spark, sf_dir) -> dict[str, Dataset]:
    d = three(spark, sf_dir)
    return dict(zip(d, times.align_time(d), strict=True))


@query(_CTE + _THREE + _ALL_SQL + _masked_sql("aligned"))
def broadcast_missing(spark, sf_dir):
    out = times.with_valid_time(masked_frame(aligned(spark, sf_dir)))
    return shown(out.select("model", "reference_time", "lead_s", "point_index", *VARIABLES, "valid_time"))


_PAIRS = _CTE + _COVERED + """, pair AS (
  SELECT f.lead_s, f.value AS a_value, f.click AS a_click, f.view AS a_view, obs.value AS b_value, obs.click AS b_click, obs.view AS b_view
  FROM fc1 f JOIN obs ON obs.point_index = f.point_index AND obs.valid_time = f.reference_time + to_seconds(f.lead_s) WHERE f.reference_time IN (SELECT reference_time FROM cov))
"""


def _metric_sql(form: str) -> str:
    return _PAIRS + "SELECT lead_s, " + ", ".join(f"floor(({form.format(a=f'a_{v}', b=f'b_{v}')}) * 1e6 + 0.5) / 1e6 AS {v}" for v in VARIABLES) + " FROM pair GROUP BY lead_s"


def _metric(spark, sf_dir, name: str, skipna: bool = True) -> DataFrame:
    d = three(spark, sf_dir)
    obs, fc = d["obs"].time.align_with(d["day"], only_common=True)
    obs = obs.with_df(obs.df.drop("valid_time"))
    out = Metric(name, name, obs, {"a": "forecast", "b": "reference"}, ["reference_time", "point_index"], skipna).compute(fc, VARIABLES)
    return out.select("lead_s", *[cut6(F.col(v)).alias(v) for v in VARIABLES])


@query(_metric_sql("sqrt(avg(({a} - {b}) * ({a} - {b})))"))
def metric_rmse(spark, sf_dir):
    return _metric(spark, sf_dir, "rmse")


@query(_metric_sql("avg({a} - {b})"))
def metric_bias(spark, sf_dir):
    return _metric(spark, sf_dir, "bias")


@query(_metric_sql("avg(abs({a} - {b}))"))
def metric_mae(spark, sf_dir):
    return _metric(spark, sf_dir, "mae")


@query(_metric_sql("avg(({a} - {b}) * ({a} - {b}))"))
def metric_mse(spark, sf_dir):
    return _metric(spark, sf_dir, "mse")


@query(_metric_sql("avg(abs({a} - {b}) / nullif({b}, 0))"))
def metric_mape(spark, sf_dir):
    return _metric(spark, sf_dir, "mape")


@query(_metric_sql("median(abs({a} - {b}))"))
def metric_median_absolute_error(spark, sf_dir):
    return _metric(spark, sf_dir, "median_absolute_error")


@query(_PAIRS + "SELECT lead_s, " + ", ".join(f"CASE WHEN count(a_{v} - b_{v}) > 1 THEN floor(corr(a_{v}, b_{v}) * 1e6 + 0.5) / 1e6 END AS {v}" for v in VARIABLES) + " FROM pair GROUP BY lead_s")
def metric_corr(spark, sf_dir):
    return _metric(spark, sf_dir, "pearson_r")


@query(_PAIRS + "SELECT lead_s, " + ", ".join(f"CASE WHEN count(a_{v} - b_{v}) = count(*) THEN floor(sqrt(avg((a_{v} - b_{v}) * (a_{v} - b_{v}))) * 1e6 + 0.5) / 1e6 END AS {v}" for v in VARIABLES) + " FROM pair GROUP BY lead_s")
def metric_rmse_strict(spark, sf_dir):
    return _metric(spark, sf_dir, "rmse", skipna=False)


_STACKED = (
    _CTE
    + _THREE
    + _ALL_SQL
    + ", masked AS ("
    + "SELECT model, reference_time, lead_s, point_index, "
    + ", ".join(f"CASE WHEN NOT max({v} IS NULL) OVER w THEN {v} END AS {v}" for v in VARIABLES)
    + " FROM aligned WINDOW w AS (PARTITION BY reference_time, lead_s, point_index)), pair AS (SELECT f.model, f.lead_s, "
    + ", ".join(f"f.{v} - r.{v} AS d_{v}" for v in VARIABLES)
    + " FROM masked f JOIN masked r ON r.model = 'obs' AND f.model <> 'obs' AND f.reference_time = r.reference_time AND f.lead_s = r.lead_s AND f.point_index = r.point_index)"
    + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, lead_s, " + ", ".join(f"floor({form.format(d='d_' + v)} * 1e6 + 0.5) / 1e6 AS {v}" for v in VARIABLES) + " FROM pair GROUP BY ALL" for m, form in (("rmse", "sqrt(avg({d} * {d}))"), ("bias", "avg({d})")))
)


def _stacked(sets: dict[str, Dataset]) -> DataFrame:
    spec = {"inputs": {"a": "forecast", "b": "reference"}, "dim": ["reference_time", "point_index"]}
    out = stacked_metrics(sets, "obs", {m: {"function": m, **spec} for m in ("rmse", "bias")})
    return out.select("model", "metric", "lead_s", *[cut6(F.col(v)).alias(v) for v in VARIABLES])


@query(_STACKED)
def metrics_stacked(spark, sf_dir):
    return _stacked(broadcast_nulls(aligned(spark, sf_dir)))


# --- sinks, pipeline, streams ----------------------------------------------------------------


@query("""
WITH d AS (SELECT DISTINCT o_orderdate AS t FROM orders), y AS (SELECT year(t) AS y FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
m AS (SELECT month(t) AS m FROM d, y WHERE year(t) = y.y GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
x AS (SELECT day(t) AS x FROM d, y, m WHERE year(t) = y.y AND month(t) = m.m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(x AS INTEGER) AS day FROM y, m, x""")
def modal_order_date(spark, sf_dir):
    return spark.createDataFrame([modal_date(table(spark, sf_dir, "orders"), "o_orderdate")], "year int, month int, day int")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in the checkpoint folder, or else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/skyverify-{uuid.uuid4().hex}"


@query(_CTE + "SELECT 'day' AS model, CAST(reference_time AS VARCHAR) AS reference_time, lead_s, point_index, value, click, view FROM fc1 UNION ALL SELECT 'two_days', CAST(reference_time AS VARCHAR), lead_s, point_index, value, click, view FROM fc2")
def save_round_trip(spark, sf_dir):
    d = three(spark, sf_dir)
    (path,) = save_sets({k: d[k] for k in ("day", "two_days")}, "to_parquet", _folder(spark) + "/{name}_{year:int(%04d)}", "merge")
    back = spark.read.parquet(path)
    return shown(back.select("model", "reference_time", "lead_s", "point_index", *VARIABLES))


@query(_STACKED)
def pipeline_config(spark, sf_dir):
    """Files to metrics through the runner: save three cubes, then load, transform, align, mask and verify them."""
    folder, d = _folder(spark), three(spark, sf_dir)
    for k, x in d.items():
        x.df.withColumnRenamed("click", "tap").join(x.places, "point_index").write.parquet(f"{folder}/{k}")
    config = {
        "datasets": {k: {"loader": "cube", "files": f"{folder}/{k}"} for k in d},
        "transformations": {"rename": {"rename_dict": {"click": ["tap"]}}},
        "alignment": {"reference": "obs", "time": {"return_as": "forecast"}},
        "verification": {"reference": "obs", "metrics": {m: {"function": m, "inputs": {"a": "forecast", "b": "reference"}, "dim": ["reference_time", "point_index"], "skipna": True} for m in ("rmse", "bias")}},
    }
    out = Runner(config, spark).run()
    return out.select("model", "metric", "lead_s", *[cut6(F.col(v)).alias(v) for v in VARIABLES])


@query("SELECT CAST(date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS BIGINT)) AS VARCHAR) AS valid_time, user_id, count(*) AS n, floor(avg(CAST(round(value * 100) AS BIGINT)) * 1e6 + 0.5) / 1e6 AS value FROM events GROUP BY ALL")
def stream_means(spark, sf_dir):
    out = observation_means(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], _cents("value"))
    return shown(out.select(F.col("valid_time").cast("timestamp_ntz").alias("valid_time"), "user_id", "n", cut6(F.col("value")).alias("value")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE and bias of two persistence forecasts against observations, by lead time."""
    return metrics_stacked(spark, sf_dir)
