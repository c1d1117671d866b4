"""The engine on hand-made cubes, its error paths, and every registered query against DuckDB."""

import re
import shutil
import sqlite3
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

import __spark_entry__
from skyverify import Config, Dataset, Dates, Metric, Properties, Runner, Space, Time, align_time, available_loaders, broadcast_nulls, load, save_dataset, transform, validate
from skyverify.functions.dates import fill, to_seconds
from skyverify.functions.projections import PRESETS, corner_gap, create_crs, project_point, resolve_crs
from skyverify.model import infer_properties
from skyverify.plans import queries as registered
from skyverify.plans import step_queries  # noqa: F401  registers more
from skyverify.sources.loaders import ordinal
from skyverify.sources.sinks import modal_date

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def hours(n):
    return T0 + timedelta(hours=n)


def forecast(spark, runs, leads, points=(0, 1, 2), f=lambda r, s, p: float(r + s + p)):
    rows = [(hours(24 * r), 3600 * s, p, f(r, s, p)) for r in runs for s in leads for p in points]
    df = spark.createDataFrame(rows, "reference_time timestamp_ntz, lead_s bigint, point_index bigint, t double")
    return Dataset(df, Properties(Space.POINT, Time.FORECAST), places(spark, points))


def observation(spark, times, points=(0, 1, 2)):
    df = spark.createDataFrame([(hours(h), p, float(h + p)) for h in times for p in points], "valid_time timestamp_ntz, point_index bigint, t double")
    return Dataset(df, Properties(Space.POINT, Time.OBSERVATION), places(spark, points))


def places(spark, points):
    return spark.createDataFrame([(p, float(p), 40.0 + p) for p in points], "point_index bigint, longitude double, latitude double")


def test_durations_and_templates():
    assert [to_seconds(x) for x in ("6h", "2D", "1W", "30m", "5s")] == [21600, 172800, 604800, 1800, 5] and to_seconds("250ms") == 0.25
    for bad in ("1M", "2Y", "x", "3q"):
        with pytest.raises(ValueError):
            to_seconds(bad)
    d = Dates("2020-02-01", "2020-03-01", "24h", "144h", "6h")
    assert len(d.reference_times) == 30 and len(d.leads) == 25 and d.valid_times[-1] == datetime(2020, 3, 7)
    assert d.substitute("/x/{reference_time:strftime(%Y%m%d%H)}.nc")[0] == "/x/2020020100.nc" and d.substitute("/one") == ["/one"]
    assert fill("{name}_{year:int(%02d)}", {"name": "a", "year": 7}) == "a_07"


def test_traits(spark):
    assert infer_properties(["reference_time", "lead_s", "grid_index", "member"]).to_attrs() == {"space": "grid", "time": "forecast", "uncertainty": "ensemble"}
    for bad in (["grid_index"], ["valid_time"]):
        with pytest.raises(ValueError):
            infer_properties(bad)
    with pytest.raises(KeyError):
        Properties.from_attrs({"space": "grid"})
    fc = forecast(spark, [0], [0])
    validate(fc)
    with pytest.raises(ValueError):
        fc.with_space(Space.GRID)
    with pytest.raises(KeyError):
        fc.select("absent")


def test_forecasts_share_runs_and_join_leads(spark):
    a, b = forecast(spark, [1, 2, 3], [0, 6, 12]), forecast(spark, [2, 3, 4], [0, 12, 24])
    x, y = a.time.align_with(b)
    assert x.df.count() == y.df.count() == 2 * 4 * 3 and x.df.where("t IS NULL").count() == 6 and "valid_time" in x.df.columns
    x, y = a.time.align_with(b, only_common=True)
    assert x.df.count() == 2 * 2 * 3 and "valid_time" not in x.df.columns
    again = align_time(align_time([a, b]))
    assert Counter(again[0].df.collect()) == Counter(align_time([a, b])[0].df.collect())
    with pytest.raises(NotImplementedError):
        align_time([a], return_as="observation")
    with pytest.raises(ValueError):
        align_time([])


def test_observations_cut_runs_and_gaps_raise(spark):
    fc = forecast(spark, [0, 1, 2], [0, 6, 12])
    whole = observation(spark, range(0, 73, 6))
    obs, same = whole.time.align_with(fc)
    assert obs.df.where("t IS NULL").isEmpty() and same.df.count() == 27 and obs.is_forecast()
    late = observation(spark, range(6, 55, 6)).time.align_with(fc, only_common=True)
    assert {r.reference_time for r in late[0].df.collect()} == {hours(24)} and late[1].df.count() == 9
    gap = observation(spark, [h for h in range(0, 73, 6) if h != 30])
    with pytest.raises(KeyError):
        gap.time.align_with(fc)
    assert gap.time.align_with(fc, on_missing="null")[0].df.where("t IS NULL").count() == 3
    with pytest.raises(ValueError):
        observation(spark, [0, 6]).time.align_with(fc)


def test_stitching(spark):
    fc, obs = forecast(spark, [0, 1, 2], [0, 12, 24, 36]), observation(spark, range(0, 100, 12))
    series = fc.time.align_with(obs)[0]
    assert series.is_observation() and series.df.where("t IS NOT NULL").count() == 6 * 3
    with pytest.raises(NotImplementedError):
        forecast(spark, [0, 1, 3], [0]).time.align_with(obs)
    with pytest.raises(IndexError):
        forecast(spark, [0], [0]).time.align_with(obs)
    with pytest.raises(KeyError):
        forecast(spark, [0, 2, 4], [0, 24]).time.align_with(obs, lead_time="start-max")


def test_masks_follow_the_pairwise_rule(spark):
    a = forecast(spark, [0, 1], [0], f=lambda r, s, p: None if p == 0 else 1.0)
    b = forecast(spark, [1, 2], [0], f=lambda r, s, p: None if (r, p) == (1, 2) else 2.0)
    out = broadcast_nulls({"a": a, "b": b})
    nulls = lambda d: {(r.reference_time, r.point_index) for r in d.df.where("t IS NULL").collect()}
    assert nulls(out["a"]) == {(hours(0), 0), (hours(24), 0), (hours(24), 2)} and nulls(out["b"]) == {(hours(24), 0), (hours(24), 2)}
    assert broadcast_nulls([a])[0] is a
    with pytest.raises(ValueError):
        broadcast_nulls([a, observation(spark, [0])])


def test_transformations(spark):
    d = observation(spark, [0])
    assert transform("rename", {"only": d}, {"x": ["t", "u"]}).variables == ["x"]
    both = transform("uv_to_speed", [d, d], "t", "t", "s")
    assert len(both) == 2 and both[0].df.where("abs(s - t * sqrt(2)) > 1e-9").isEmpty()
    series = transform("external", d, func_path="skyverify.functions.derived.ratio", inputs={"part": "t", "whole": "t"}, output="o", vectorised=True, scale=2.0)
    assert {r.o for r in series.df.where("t > 0").collect()} == {2.0}
    with pytest.raises(ValueError):
        transform("absent", d)
    with pytest.raises(ImportError):
        transform("external", d, func_path="no.such.fn", inputs={}, output="o")
    with pytest.raises(AttributeError):
        transform("external", d, func_path="math.absent", inputs={}, output="o")
    with pytest.raises(ValueError):
        transform("rename", both[0], {"x": ["t", "s"]})


def test_projections():
    for name in ("cerra", "uwcw_consistent"):
        assert max(map(abs, corner_gap(resolve_crs(name), PRESETS[name]["kws_grid"]))) < 0.01
    with pytest.raises(ValueError):
        create_crs("Robinson")
    away = create_crs("Orthographic", {"central_longitude": 5.0, "central_latitude": 45.0})
    assert all(np.isnan(project_point(away, 185.0, -45.0))) and not any(np.isnan(project_point(away, 80.0, 10.0)))
    ocean = create_crs("Orthographic", {"central_longitude": 5.0, "central_latitude": 55.0})  # the worked example of EPSG's guidance note
    assert np.allclose(project_point(ocean, 2.12955, 53.80939444), (-189011.711, -128640.567), atol=0.01)
    with pytest.raises(ValueError):
        resolve_crs("absent")


def test_stations_and_sinks(spark, tmp_path):
    path = str(tmp_path / "obs.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE SYNOP (SID INTEGER, validdate INTEGER, lat REAL, lon REAL, elev REAL, t REAL, q REAL)")
        db.executemany("INSERT INTO SYNOP VALUES (?,?,?,?,?,?,?)", [(7, 0, 50, 4, 10, 1.5, None), (7, 3600, 50, 4, 12, 2.5, 1), (3, 0, 51, 5, 20, float("nan"), 2)])
    ds = load(spark, "stations", path, "t")
    rows = {(r.point_index, r.valid_time): r.t for r in ds.df.collect()}
    assert rows == {(0, T0.replace(year=1970)): None, (0, datetime(1970, 1, 1, 1)): None, (1, datetime(1970, 1, 1)): 1.5, (1, datetime(1970, 1, 1, 1)): 2.5}
    assert {(r.code, r.elevation) for r in ds.places.collect()} == {(3, 20.0), (7, 10.0)}
    with pytest.raises(KeyError):
        load(spark, "stations", path, "absent")
    with pytest.raises(NotImplementedError):
        load(spark, "stations", [path, path])
    twice = str(tmp_path / "twice.sqlite")
    shutil.copy(path, twice)
    with sqlite3.connect(twice) as db:
        db.execute("INSERT INTO SYNOP VALUES (7, 0, 50, 4, 10, 9, 9)")
    with pytest.raises(ValueError):
        load(spark, "stations", twice)
    with pytest.raises(ValueError):
        load(spark, "absent", path)
    assert {"analysis", "cube", "runs", "stations"} <= set(available_loaders())
    out = save_dataset("to_csv", "s", ds, str(tmp_path) + "/{name}_{year:int(%04d)}")
    assert out.endswith("s_1970") and spark.read.csv(out, header=True).count() == 4
    with pytest.raises(ValueError):
        save_dataset("to_absent", "s", ds, out)
    days = spark.createDataFrame([(datetime(2020, 1, 1),), (datetime(2020, 1, 2),), (datetime(2021, 5, 5),), (datetime(2020, 3, 1),)], "d timestamp_ntz")
    assert modal_date(days, "d") == (2020, 1, 1)


def test_metrics_and_config(spark):
    fc, ref = forecast(spark, [0, 1], [0, 6]), forecast(spark, [0, 1], [0, 6], f=lambda r, s, p: None if p == 2 else float(r + s + p + 2))
    inputs = {"a": "forecast", "b": "reference"}
    dim = ["reference_time", "point_index"]
    assert {r.t for r in Metric("m", "rmse", ref, inputs, dim).compute(fc).collect()} == {2.0}
    assert {r.t for r in Metric("m", "bias", ref, {"b": "reference", "a": "x"}, dim).compute(fc).collect()} == {2.0}
    assert {r.t for r in Metric("m", "rmse", ref, inputs, dim, skipna=False).compute(fc).collect()} == {None}
    own = Metric("m", lambda a, b: np.abs(a - b).max(), ref, inputs, dim).compute(fc).collect()
    assert {r.t for r in own} == {2.0}
    with pytest.raises(ValueError):
        Metric("m", "rmse", ref, {"a": "x", "b": "y"})
    with pytest.raises(IndexError):
        Metric("m", "rmse", ref, {"b": "reference"})
    with pytest.raises(ValueError):
        Config({"dates": {}})
    with pytest.raises(TypeError):
        Config(3)
    c = Config({"dates": {"start": "2020-01-01", "end": "2020-01-03", "period": "1D", "range": "6h", "step": "6h"}, "datasets": {"a": {"loader": "cube", "files": "/x/{reference_time:strftime(%d)}", "dates": {"end": "2020-01-02"}}}})
    assert c["datasets"]["a"]["files"] == ["/x/01", "/x/02"] and c["absent"] is None
    with pytest.raises(FileNotFoundError):
        Runner(c, spark).load_datasets()


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registered.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(registered.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(tuple(r[k] for k in order) for r in want.fetchall())


def test_codes_are_numbered_by_their_numbers(spark, tmp_path):
    """Users beyond u9999, whose order as plain text is another."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + 1000000 * k AS event_id, ts, user_id + 8991 * k AS user_id, event_type, value FROM '{SF}/events.parquet', range(12) AS r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(registered.SQL["load_cube_with_codes"]).fetchall()
    got = registered.QUERIES["load_cube_with_codes"](spark, str(tmp_path))
    assert {len(r[2]) for r in want} == {5, 6} and Counter(tuple(r) for r in got.collect()) == Counter(want)
    codes = ["", "5", "010", "10", "a", "a2", "a02b", "a2c", "a10", "a00000000000000000000011", "ab1", "b"]
    numbered = ordinal(spark.createDataFrame([(c,) for c in reversed(codes)], "code string"), "code", "nr")
    assert [r.code for r in numbered.orderBy("nr").collect()] == codes and sorted(r.nr for r in numbered.collect()) == list(range(len(codes)))


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("align_obs_fc", 2, 4), ("align_time_three", 8, 10), ("broadcast_missing", 8, 10), ("metrics_stacked", 8, 12), ("metric_rmse", 3, 6)])
def test_plans_restate_nothing(spark, name, scans, exchanges):
    """A dataset's source is read for its cells and for its places, and all datasets meet by one exchange."""
    plan = registered.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)", plan)) <= exchanges
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
