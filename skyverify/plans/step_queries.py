"""Registered queries of single steps: loaders from files, extension points, spatial alignment, writers.

They write small tables to the shared folder first, as these steps begin or end with files.
"""

from __future__ import annotations

import sqlite3
from contextlib import closing
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import Dates, add_seconds, fill, to_seconds
from ..functions.metrics import brier_score
from ..functions.projections import PRESETS, project_point, resolve_crs
from ..model import Dataset, Properties, Space, Time, Uncertainty, infer_properties
from ..operators import interpolate as interpolate_sets
from ..operators import space_alignment as grids
from ..operators.interpolate import available_interpolations, delaunay, register_interpolator
from ..operators.transform import available_transformations, register_transformation, transform
from ..operators.verify import Metric, rank_histogram, verify, verify_ensemble
from ..sources.arrays import _hadoop
from ..sources.loaders import available_loaders, load, register_loader
from ..sources.sinks import save_dataset, save_metrics, save_sets
from . import queries as base
from .queries import _BILINEAR_SQL, _CELL_SQL, _CTE, _FIELD, _PAIRS, _R, _STACKED, _SUM, VARIABLES, _folder, _metric_sql, cut6, field, floor_6h, query, shown, suppliers, table, three
from .runner import Runner, spatial_options

_BILINEAR = _FIELD + "," + _CELL_SQL.format(x="longitude", y="(latitude - 40)", frame="points")


def _cent2(ds: Dataset) -> DataFrame:
    return shown(ds.df.withColumn("price", F.floor(F.col("price") * 100 + 0.5) / 100).select("valid_time", "point_index", "price"))


def _fails(fn) -> str:
    """The name of the exception that a call ends with."""
    try:
        fn()
    except Exception as e:
        return type(e).__name__
    return ""


# --- sources ---------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('loader', 'analysis'), ('loader', 'cube'), ('loader', 'runs'), ('loader', 'stations'), ('transformation', 'external'), ('transformation', 'rename'), ('transformation', 'uv_to_speed'), ('interpolation', 'bilinear'), ('interpolation', 'delaunay'), ('interpolation', 'nearest')) AS t(kind, name)")
def registries(spark, sf_dir):
    have = {"loader": available_loaders(), "transformation": available_transformations(), "interpolation": available_interpolations()}
    wanted = {"analysis", "cube", "runs", "stations", "external", "rename", "uv_to_speed", "bilinear", "delaunay", "nearest"}
    return spark.createDataFrame([(k, n) for k, names in have.items() for n in names if n in wanted], "kind string, name string")


@query("""
WITH long AS (
  SELECT date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS BIGINT)) AS valid_time, event_type, user_id AS grid_index, sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100::DOUBLE AS data
  FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT CAST(valid_time AS VARCHAR) AS valid_time, grid_index, max(CASE WHEN event_type = 'click' THEN data END) AS click, max(CASE WHEN event_type = 'view' THEN data END) AS view
FROM long WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def load_analysis_stores(spark, sf_dir):
    """Two stores after each other, through the loader."""
    e = table(spark, sf_dir, "events").select(floor_6h("ts").alias("dates"), F.col("event_type").alias("variable"), (F.col("event_id") % 2).cast("int").alias("ensemble"), F.col("user_id").alias("cell"), base._cents("value").alias("c"))
    long = e.groupBy("dates", "variable", "ensemble", "cell").agg(base._mean().alias("data")).withColumns({"longitudes": F.col("cell") / 10.0, "latitudes": F.lit(50.0)})
    folder, middle = _folder(spark), F.lit("2024-01-15").cast("timestamp_ntz")
    long.where(F.col("dates") < middle).write.parquet(f"{folder}/first")
    long.where(F.col("dates") >= middle).union(long.where(F.col("dates") >= middle).withColumn("variable", F.lit("insolation"))).write.parquet(f"{folder}/second")
    return shown(load(spark, "analysis", [f"{folder}/first", f"{folder}/second"], ["click", "view"]).df)


_RUNS_SQL = """
WITH keys AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey <= 40)
SELECT CAST(min(l_shipdate) OVER w AS VARCHAR) AS reference_time, CAST(epoch(l_shipdate) - epoch(min(l_shipdate) OVER w) AS BIGINT) AS lead_s, CAST(l_linenumber AS BIGINT) AS grid_index, l_quantity
FROM keys WINDOW w AS (PARTITION BY l_orderkey)"""


@query(_RUNS_SQL)
def load_run_files(spark, sf_dir):
    """One file for each run, whose first time is its reference time."""
    folder = _folder(spark)
    steps = table(spark, sf_dir, "lineitem").where("l_orderkey <= 40").select("l_orderkey", F.col("l_shipdate").cast("timestamp_ntz").alias("time"), F.col("l_linenumber").alias("values"), "l_quantity", F.lit(4.0).alias("longitude"), F.lit(50.0).alias("latitude"))
    steps.repartition(1, "l_orderkey").write.partitionBy("l_orderkey").parquet(folder)
    return shown(load(spark, "runs", f"{folder}/*/*.parquet", "l_quantity").df.select("reference_time", "lead_s", "grid_index", "l_quantity"))


_STATIONS_SQL = """
WITH s AS (SELECT c_custkey % 7 AS sid, c_custkey * 3600 AS t, c_acctbal AS v FROM customer WHERE c_custkey <= 60),
codes AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS point_index FROM (SELECT DISTINCT sid FROM s))
SELECT CAST(to_timestamp(x.t)::TIMESTAMP AS VARCHAR) AS valid_time, c.point_index, c.sid AS code, 50 + c.sid::DOUBLE AS latitude, c.sid / 2::DOUBLE AS longitude, s.v AS t2m
FROM (SELECT DISTINCT t FROM s) x CROSS JOIN codes c LEFT JOIN s ON s.t = x.t AND s.sid = c.sid"""


@query(_STATIONS_SQL)
def load_stations(spark, sf_dir):
    """A SQLite file of station records, dense, with its stations' coordinates."""
    rows = table(spark, sf_dir, "customer").where("c_custkey <= 60").select("c_custkey", "c_acctbal").collect()  # a fixture of 60 rows
    with closing(sqlite3.connect(":memory:")) as db:
        db.execute("CREATE TABLE SYNOP (SID INTEGER, validdate INTEGER, lat REAL, lon REAL, elev REAL, t2m REAL, unused REAL)")
        db.executemany("INSERT INTO SYNOP VALUES (?,?,?,?,?,?,?)", [(k % 7, 3600 * k, 50.0 + k % 7, k % 7 / 2, 1.0, v, 0.0) for k, v in rows])
        db.commit()
        data = db.serialize()
    path = _folder(spark) + ".sqlite"
    where, store = _hadoop(spark, path)
    with closing(store.create(where)) as out:
        out.write(bytearray(data))
    ds = load(spark, "stations", path, "t2m")
    return shown(ds.df.join(ds.places.select("point_index", F.col("code").cast("long").alias("code"), "latitude", "longitude"), "point_index").select("valid_time", "point_index", "code", "latitude", "longitude", "t2m"))


@query(_CTE + "SELECT CAST(valid_time AS VARCHAR) AS valid_time, dense_rank() OVER (ORDER BY point_index) - 1 AS point_index, CAST('u' || (point_index + 1000) AS VARCHAR) AS code, value FROM obs")
def load_cube_with_codes(spark, sf_dir):
    """Stations by code get numbers from 0."""
    folder = _folder(spark)
    obs = three(spark, sf_dir)["obs"]
    obs.df.join(obs.places, "point_index").withColumn("code", F.concat(F.lit("u"), F.col("point_index") + 1000)).drop("point_index").write.parquet(folder)
    ds = load(spark, "cube", folder, "value")
    return shown(ds.df.join(ds.places.select("point_index", "code"), "point_index").select("valid_time", "point_index", "code", "value"))


@query(_CTE + "SELECT CAST(valid_time AS VARCHAR) AS valid_time, point_index, value * 2 AS value FROM obs")
def own_loader(spark, sf_dir):
    @register_loader("doubled")
    def doubled(spark, paths, variables=None, **options):
        df = spark.read.parquet(*paths)
        return Dataset(df.select("valid_time", "point_index", (F.col("value") * 2).alias("value")), infer_properties(df.columns), df.select("point_index", "longitude", "latitude").distinct())

    folder, obs = _folder(spark), three(spark, sf_dir)["obs"]
    obs.df.join(obs.places, "point_index").write.parquet(folder)
    return shown(load(spark, "doubled", folder).df)


@query("SELECT * FROM (VALUES ('24h', 86400.0::DOUBLE), ('6h', 21600), ('90m', 5400), ('15s', 15), ('2D', 172800), ('1W', 604800), ('500ms', 0.5)) AS t(duration, seconds)")
def durations(spark, sf_dir):
    return spark.createDataFrame([(d, float(to_seconds(d))) for d in ("24h", "6h", "90m", "15s", "2D", "1W", "500ms")], "duration string, seconds double")


@query("SELECT strftime(r, '/in/%Y%m%d%H/run.parquet') AS path FROM (SELECT unnest(generate_series(TIMESTAMP '2020-02-01', TIMESTAMP '2020-02-10', INTERVAL 12 HOUR)) AS r)")
def path_templates(spark, sf_dir):
    dates = Dates("2020-02-01T00:00:00", "2020-02-10T00:00:00", "12h", "6h", "6h")
    return spark.createDataFrame([(p,) for p in dates.substitute("/in/{reference_time:strftime(%Y%m%d%H)}/run.parquet")], "path string")


@query("SELECT 'day/2024/01' AS path, 'obs_07' AS other")
def filled_templates(spark, sf_dir):
    return spark.createDataFrame([(fill("{name}/{year:int(%04d)}/{month:int(%02d)}", {"name": "day", "year": 2024, "month": 1}), fill("{name}_{day:int(%02d)}", {"name": "obs", "day": 7}))], "path string, other string")


# --- transformations, traits -----------------------------------------------------------------


@query(_CTE + "SELECT CAST(valid_time AS VARCHAR) AS valid_time, point_index, greatest(value, 250) AS value, click, view FROM obs")
def own_transformation(spark, sf_dir):
    @register_transformation("at_least")
    def at_least(ds, variable, least):
        return ds.with_df(ds.df.withColumn(variable, F.when(F.col(variable).isNotNull(), F.greatest(F.col(variable), F.lit(least)))))

    return shown(transform("at_least", three(spark, sf_dir)["obs"], "value", 250.0).df)


@query("SELECT * FROM (VALUES ('reference_time,lead_s,grid_index', 'grid', 'forecast', 'deterministic'), ('valid_time,point_index,member', 'point', 'observation', 'ensemble'), ('valid_time,latitude,longitude,quantile', 'grid', 'observation', 'quantile'), ('valid_time,xc,yc', 'grid', 'observation', 'deterministic')) AS t(columns, space, time, uncertainty)")
def traits_round_trip(spark, sf_dir):
    """Traits by column names, as attributes and back."""
    rows = []
    for columns in ("reference_time,lead_s,grid_index", "valid_time,point_index,member", "valid_time,latitude,longitude,quantile", "valid_time,xc,yc"):
        p = Properties.from_attrs(infer_properties(columns.split(",")).to_attrs())
        rows.append((columns, str(p.space), str(p.time), str(p.uncertainty)))
    return spark.createDataFrame(rows, "columns string, space string, time string, uncertainty string")


# --- grids and spatial alignment -------------------------------------------------------------


_GRID_LCC = f"""
WITH n AS (SELECT sin(radians(50)) AS n), f AS (SELECT n, cos(radians(50)) * pow(tan(pi() / 4 + radians(50) / 2), n) / n AS f FROM n),
g AS (SELECT n_nationkey::BIGINT AS grid_index, 40::DOUBLE + n_nationkey // 5 AS latitude, (n_nationkey % 5)::DOUBLE AS longitude FROM nation)
SELECT grid_index, floor({_R} * f / pow(tan(pi() / 4 + radians(latitude) / 2), n) * sin(n * radians(longitude - 8)) * 1000 + 0.5) / 1000 AS xc,
  floor(({_R} * f / pow(tan(pi() / 4 + radians(50) / 2), n) - {_R} * f / pow(tan(pi() / 4 + radians(latitude) / 2), n) * cos(n * radians(longitude - 8))) * 1000 + 0.5) / 1000 AS yc FROM g, f"""


@query(_GRID_LCC)
def grid_xy(spark, sf_dir):
    """Projection by preset, grid mapping and projected coordinates of a grid's places."""
    ds = field(spark, sf_dir).space.add_crs("CERRA").space.add_grid_mapping("cerra").space.add_xy()
    mm = lambda c: F.floor(F.col(c) * 1000 + 0.5) / 1000
    return ds.places.select("grid_index", mm("xc").alias("xc"), mm("yc").alias("yc"))


@query("SELECT * FROM (VALUES ('cerra', 1069, 1069, 5500.0::DOUBLE, true), ('uwcw', 1909, 1609, 2000, false), ('uwcw_consistent', 1909, 1609, 2000, true)) AS t(preset, nx, ny, dx, fits)")
def grid_presets(spark, sf_dir):
    """Whether the corners that a preset states are nx and ny cells apart."""
    rows = []
    for name, preset in PRESETS.items():
        g, crs = preset["kws_grid"], resolve_crs(name)
        (x0, y0), (x1, y1) = project_point(crs, g["lon_ll"], g["lat_ll"]), project_point(crs, g["lon_ur"], g["lat_ur"])
        rows.append((name, g["nx"], g["ny"], g["dx"], abs((x1 - x0) / g["dx"] - g["nx"] + 1) < 0.01 and abs((y1 - y0) / g["dy"] - g["ny"] + 1) < 0.01))
    return spark.createDataFrame(rows, "preset string, nx int, ny int, dx double, fits boolean")


@query(_BILINEAR + _BILINEAR_SQL.format(v=f"floor(({_SUM}) * 100 + 0.5) / 100", frame="points"))
def align_grid_point(spark, sf_dir):
    """A grid brought to points by the datasets' own alignment."""
    return _cent2(field(spark, sf_dir).space.align_with(suppliers(spark, sf_dir), method="bilinear")[0])


@query(_BILINEAR + "SELECT 'a' AS model, * FROM (" + _BILINEAR_SQL.format(v=f"floor(({_SUM}) * 100 + 0.5) / 100", frame="points") + ") UNION ALL SELECT 'b', * FROM (" + _BILINEAR_SQL.format(v=f"floor((2 * ({_SUM})) * 100 + 0.5) / 100", frame="points") + ")")
def align_space_all(spark, sf_dir):
    """Several grids aligned to one set of points."""
    source = field(spark, sf_dir)
    twice = source.with_df(source.df.withColumn("price", F.col("price") * 2))
    a, b = grids.align_space({"a": source, "b": twice}, suppliers(spark, sf_dir))
    return _cent2(a).select(F.lit("a").alias("model"), "*").union(_cent2(b).select(F.lit("b").alias("model"), "*"))


@query("SELECT * FROM (VALUES ('grid to another grid', 'NotImplementedError'), ('point to point', 'NotImplementedError'), ('point to grid', 'NotImplementedError'), ('projection of points', 'ValueError'), ('grid mapping of points', 'ValueError'), ('unstacked grid', 'ValueError'), ('cubic triangles', 'ValueError'), ('unknown interpolation', 'ValueError'), ('no projection', 'ValueError'), ('unstack without projection', 'KeyError'), ('grid to the same grid', '')) AS t(step, error)")
def refusals(spark, sf_dir):
    """What spatial steps refuse, by the error's kind."""
    g, p = field(spark, sf_dir), suppliers(spark, sf_dir)
    moved = g.with_df(g.df, places=g.places.withColumn("latitude", F.col("latitude") + 1))
    flat = Dataset(g.df.withColumnRenamed("grid_index", "xc").withColumn("yc", F.lit(0.0)), Properties(Space.GRID, Time.OBSERVATION))
    steps = {
        "grid to another grid": lambda: g.space.align_with(moved), "point to point": lambda: p.space.align_with(p), "point to grid": lambda: p.space.align_with(g), "projection of points": lambda: p.space.add_crs("cerra"),
        "grid mapping of points": lambda: p.space.add_grid_mapping("cerra"), "unstacked grid": lambda: interpolate_sets(flat, p), "cubic triangles": lambda: delaunay(g, p, method="cubic"),
        "unknown interpolation": lambda: interpolate_sets(g, p, "absent"), "no projection": lambda: g.space.add_xy(), "unstack without projection": lambda: g.space.unstack(), "grid to the same grid": lambda: g.space.align_with(g),
    }
    return spark.createDataFrame([(k, _fails(f)) for k, f in steps.items()], "step string, error string")


@query("SELECT * FROM (VALUES ('grid to point', 'interpolation'), ('grid to grid', 'regrid'), ('point to point', 'none')) AS t(pair, options)")
def spatial_routing(spark, sf_dir):
    """Which of the configured options a pair of datasets gets."""
    g, p, options = field(spark, sf_dir), suppliers(spark, sf_dir), {"interpolation": {"method": "interpolation"}, "regrid": {"method": "regrid"}}
    pairs = {"grid to point": (g, p), "grid to grid": (g, g), "point to point": (p, p)}
    return spark.createDataFrame([(k, (spatial_options(a, b, options) or {"method": "none"})["method"]) for k, (a, b) in pairs.items()], "pair string, options string")


@query(_FIELD + "SELECT CAST(valid_time AS VARCHAR) AS valid_time, point_index, price FROM field CROSS JOIN points WHERE grid_index = 7")
def own_interpolator(spark, sf_dir):
    @register_interpolator("cell_seven")
    def cell_seven(source, target):
        return target.places.select("point_index", F.lit(0).alias("corner"), F.lit(7).cast("long").alias("grid_index"), F.lit(1.0).alias("w")), 1

    return shown(interpolate_sets(field(spark, sf_dir), suppliers(spark, sf_dir), "cell_seven").df)


_SPACE_RUN = _BILINEAR + """, aligned AS (""" + _BILINEAR_SQL.format(v=_SUM, frame="points") + """),
ref AS (SELECT CAST(t.valid_time AS VARCHAR) AS valid_time, q.point_index, q.point_index * 100::DOUBLE AS price FROM points q CROSS JOIN (SELECT DISTINCT valid_time FROM field) t WHERE q.point_index % 3 <> 0)
SELECT 'grid' AS model, 'mae' AS metric, a.point_index, floor(avg(abs(a.price - r.price)) * 100 + 0.5) / 100 AS price FROM aligned a JOIN ref r ON a.valid_time = r.valid_time AND a.point_index = r.point_index GROUP BY a.point_index"""


@query(_SPACE_RUN)
def runner_space_and_save(spark, sf_dir):
    """Files of a grid and of points through the runner: space step, mask, saved sets and saved metrics."""
    folder, g = _folder(spark), field(spark, sf_dir)
    g.df.join(g.places, "grid_index").write.parquet(f"{folder}/grid")
    p = suppliers(spark, sf_dir).places.where("point_index % 3 <> 0")
    g.df.select("valid_time").distinct().crossJoin(p).withColumn("price", F.col("point_index") * 100.0).write.parquet(f"{folder}/points")
    config = {
        "datasets": {"grid": {"loader": "cube", "files": [f"{folder}/grid", f"{folder}/absent"]}, "points": {"loader": "cube", "files": f"{folder}/points"}},
        "alignment": {"reference": "points", "space": {"interpolation": {"method": "bilinear"}}, "save": {"method": "to_parquet", "path": folder + "/out_{name}_{year:int(%04d)}"}},
        "verification": {"reference": "points", "metrics": {"mae": {"function": "mae", "inputs": {"a": "forecast", "b": "reference"}, "dim": "valid_time"}}, "save": {"method": "to_parquet", "path": f"{folder}/metrics"}},
    }
    Runner(config, spark).run()
    back = spark.read.parquet(f"{folder}/metrics")
    return back.select("model", "metric", "point_index", (F.floor(F.col("price") * 100 + 0.5) / 100).alias("price"))


@query(_BILINEAR + _BILINEAR_SQL.format(v=f"floor(({_SUM}) * 100 + 0.5) / 100", frame="points"))
def preset_at_load(spark, sf_dir):
    """A grid mapping given as the loader's option; latitude and longitude stay the grid's own."""
    folder, g = _folder(spark), field(spark, sf_dir)
    g.df.join(g.places, "grid_index").write.parquet(folder)
    ds = load(spark, "cube", folder, grid_mapping="cerra")
    assert ds.crs["projection"] == "lcc" and ds.grid["nx"] == 1069
    return _cent2(interpolate_sets(ds.with_df(ds.df, crs=None, grid=None), suppliers(spark, sf_dir)))


# --- metrics and writers ---------------------------------------------------------------------


def _common_pair(spark, sf_dir) -> tuple[Dataset, Dataset]:
    d = three(spark, sf_dir)
    obs, fc = d["obs"].time.align_with(d["day"], only_common=True)
    return obs.with_df(obs.df.drop("valid_time")), fc


@query(_metric_sql("avg(abs({a} - {b}))"))
def verify_one(spark, sf_dir):
    obs, fc = _common_pair(spark, sf_dir)
    out = verify(fc, obs, "mae", {"a": "forecast", "b": "observation"}, ["reference_time", "point_index"])
    return out.select("lead_s", *[cut6(F.col(v)).alias(v) for v in VARIABLES])


_LARGEST = _PAIRS + "SELECT lead_s, '{0}' AS rule, " + ", ".join(f"CASE WHEN {{1}} THEN floor(max(abs(a_{v} - b_{v})) * 1e6 + 0.5) / 1e6 END AS {v}".replace("{1}", "{1}" + f"count(a_{v} - b_{v}) = count(*)") for v in VARIABLES) + " FROM pair GROUP BY lead_s"


@query(_LARGEST.replace("{0}", "skip").replace("{1}", "true OR ") + " UNION ALL " + _LARGEST[len(_PAIRS):].replace("{0}", "strict").replace("{1}", ""))
def metric_own_function(spark, sf_dir):
    """A function of arrays by its dotted path, with and without missing values."""
    obs, fc = _common_pair(spark, sf_dir)
    parts = []
    for rule, skip in (("skip", True), ("strict", False)):
        out = Metric("largest", "skyverify.functions.derived.largest_error", obs, {"a": "forecast", "b": "reference"}, ["reference_time", "point_index"], skip).compute(fc, VARIABLES)
        parts.append(out.select("lead_s", F.lit(rule).alias("rule"), *[cut6(F.col(v)).alias(v) for v in VARIABLES]))
    return parts[0].union(parts[1])


_MEMBERS = _CTE + """, ens AS (
  SELECT reference_time, lead_s, point_index, back AS member, value FROM days CROSS JOIN (SELECT unnest([0, 21600, 43200])::BIGINT AS lead_s) CROSS JOIN (SELECT unnest([24, 48, 72, 96]) AS back)
  JOIN obs ON obs.valid_time + to_hours(back) = reference_time + to_seconds(lead_s)),
cell AS (SELECT e.lead_s, e.reference_time, e.point_index, list_sort(list(e.value)) AS m, any_value(o2.value) AS y FROM ens e JOIN obs o2 ON o2.valid_time = e.reference_time + to_seconds(e.lead_s) AND o2.point_index = e.point_index WHERE e.value IS NOT NULL AND o2.value IS NOT NULL GROUP BY ALL),
score AS (SELECT lead_s, list_avg(list_transform(m, lambda x: abs(x - y))) - list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i] * (2 * i - len(m) - 1))) / (len(m) * len(m)) AS crps,
  list_stddev_samp(m) AS spread, len(list_filter(m, lambda x: x < y)) AS below, pow(len(list_filter(m, lambda x: x > 250)) / len(m) - CASE WHEN y > 250 THEN 1 ELSE 0 END, 2) AS brier FROM cell)
"""


def ensemble(spark, sf_dir) -> tuple[Dataset, Dataset]:
    """Four members, each what was observed a number of days before; and the observations on their axes."""
    obs = three(spark, sf_dir)["obs"]
    parts = []
    for back in (24, 48, 72, 96):
        fc = base.persistence(obs, [0, 6, 12], back)
        parts.append(fc.df.select("reference_time", "lead_s", F.lit(back).alias("member"), "point_index", "value"))
    every = Dataset(reduce(DataFrame.union, parts), Properties(Space.POINT, Time.FORECAST, Uncertainty.ENSEMBLE), obs.places)
    lead = F.explode(F.array(*[F.lit(3600 * h).cast("long") for h in (0, 6, 12)])).alias("lead_s")
    there = obs.df.select("*", lead).withColumn("reference_time", add_seconds(F.col("valid_time"), -F.col("lead_s")))
    return every, Dataset(there.select("reference_time", "lead_s", "point_index", "value"), Properties(Space.POINT, Time.FORECAST), obs.places)


@query(_MEMBERS + "SELECT lead_s, floor(avg(crps) * 1e6 + 0.5) / 1e6 AS crps, floor(avg(spread) * 1e6 + 0.5) / 1e6 AS spread, floor(avg(brier) * 1e6 + 0.5) / 1e6 AS brier FROM score GROUP BY lead_s")
def ensemble_scores(spark, sf_dir):
    fc, obs = ensemble(spark, sf_dir)
    dim, out = ["reference_time", "point_index"], None
    for name, fn in (("crps", "crps_ensemble"), ("spread", "spread"), ("brier", brier_score(250.0))):
        one = verify_ensemble(fc, obs, fn, dim).select("lead_s", cut6(F.col("value")).alias(name))
        out = one if out is None else out.join(one, "lead_s")
    return out


@query(_MEMBERS + "SELECT lead_s, below AS rank, count(*) AS n FROM score GROUP BY ALL")
def ensemble_ranks(spark, sf_dir):
    fc, obs = ensemble(spark, sf_dir)
    return rank_histogram(fc, obs, "value", ["reference_time", "point_index"])


@query(_CTE + "SELECT 'day' AS model, CAST(reference_time AS VARCHAR) AS reference_time, lead_s, point_index, value FROM fc1 UNION ALL SELECT 'two_days', CAST(reference_time AS VARCHAR), lead_s, point_index, value FROM fc2")
def save_all_sets(spark, sf_dir):
    """One output for each dataset, in another format."""
    d = three(spark, sf_dir)
    paths = save_sets({k: d[k] for k in ("day", "two_days")}, "to_orc", _folder(spark) + "/{name}", "all")
    parts = [spark.read.orc(p).select(F.lit(k).alias("model"), "reference_time", "lead_s", "point_index", "value") for k, p in zip(("day", "two_days"), paths, strict=True)]
    return shown(parts[0].union(parts[1]))


@query(_CTE + "SELECT CAST(reference_time AS VARCHAR) AS reference_time, lead_s, point_index, value, click FROM fc1 WHERE reference_time < TIMESTAMP '2024-01-05'")
def zarr_round_trip(spark, sf_dir):
    """A forecast written as a Zarr store and loaded again; the store is dense, and here only cells with a value count."""
    fc = three(spark, sf_dir)["day"]
    path = save_dataset("to_zarr", "day", fc.with_df(fc.df.where("reference_time < timestamp_ntz'2024-01-05'").select("reference_time", "lead_s", "point_index", "value", "click")), _folder(spark) + "/{name}.zarr")
    return shown(load(spark, "cube", path).df.where("value IS NOT NULL").select("reference_time", "lead_s", "point_index", "value", "click"))


@query(_CTE + "SELECT CAST(valid_time AS VARCHAR) AS valid_time, point_index, value FROM obs WHERE valid_time < TIMESTAMP '2024-01-04'")
def netcdf_round_trip(spark, sf_dir):
    """Observations written as NetCDF files, one for each time, and loaded again."""
    obs = three(spark, sf_dir)["obs"]
    path = save_dataset("to_netcdf", "obs", obs.with_df(obs.df.where("valid_time < timestamp_ntz'2024-01-04'").select("valid_time", "point_index", "value")), _folder(spark) + "/{name}")
    return shown(load(spark, "cube", f"{path}/*.nc", fmt="nc").df.where("value IS NOT NULL").select("valid_time", "point_index", "value"))


@query(_STACKED)
def save_metrics_round_trip(spark, sf_dir):
    path = _folder(spark)
    save_metrics("to_json", base.metrics_stacked(spark, sf_dir), path)
    return spark.read.schema("model string, metric string, lead_s bigint, value double, click double, view double").json(path)
