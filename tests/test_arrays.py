"""NetCDF and Zarr: bytes written by hand, round trips, loaders."""

import json
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyverify import load, save_dataset
from skyverify.model import Dataset, Properties, Space, Time
from skyverify.sources import arrays

T0 = datetime(2024, 1, 1)


def run_file(start, steps=3, cells=4, wide=False):
    """A classic file of a forecast run, with time as the record dimension, written plainly."""
    name = lambda x: struct.pack(">i", len(x)) + x.encode() + b"\0" * (-len(x) % 4)
    units = f"hours since {start:%Y-%m-%d %H:%M:%S}"
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    dims = struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("values") + struct.pack(">i", cells)
    fill = name("_FillValue") + struct.pack(">iih", 3, 1, -999) + b"\0\0"
    scale = name("scale_factor") + struct.pack(">iid", 6, 1, 0.1)
    heads = [
        (name("latitude") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 0, 0), 6, 8 * cells),
        (name("longitude") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 0, 0), 6, 8 * cells),
        (name("time") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 12, 1) + text("units", units), 4, 4),
        (name("2t") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 12, 2) + fill + scale, 3, -(-2 * cells // 4) * 4),
    ]
    magic, offset = (b"CDF\2", "q") if wide else (b"CDF\1", "i")

    def header(begins):
        return magic + struct.pack(">i", steps) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 4) + b"".join(h + struct.pack(f">ii{offset}", t, s, b) for (h, t, s), b in zip(heads, begins, strict=True))

    n = len(header([0] * 4))
    begins = [n, n + 8 * cells, n + 16 * cells, n + 16 * cells + 4]
    body = np.arange(cells, dtype=">f8").tobytes() + (np.arange(cells) + 10).astype(">f8").tobytes()
    for k in range(steps):
        values = np.array([k * 100 + c for c in range(cells)], ">i2")
        if k == 1:
            values[2] = -999
        body += struct.pack(">i", 6 * k) + values.tobytes() + b"\0" * (-2 * cells % 4)
    return header(begins) + body


@pytest.mark.parametrize(("cells", "wide"), [(4, False), (3, True)])
def test_run_files_of_classic_netcdf(spark, tmp_path, cells, wide):
    for k in range(2):
        (tmp_path / f"run{k}.nc").write_bytes(run_file(T0 + timedelta(days=k), cells=cells, wide=wide))
    ds = load(spark, "runs", [str(tmp_path / "run0.nc"), str(tmp_path / "run1.nc")], "2t")
    assert ds.is_forecast() and ds.is_grid()
    rows = {(r.reference_time, r.lead_s, r.grid_index): r["2t"] for r in ds.df.collect()}
    want = {(T0 + timedelta(days=d), 21600 * k, c): None if (k, c) == (1, 2) else (k * 100 + c) * 0.1 for d in range(2) for k in range(3) for c in range(cells)}
    assert rows.keys() == want.keys() and all(rows[k] == want[k] or abs(rows[k] - want[k]) < 1e-12 for k in want)
    assert {(r.grid_index, r.latitude, r.longitude) for r in ds.places.collect()} == {(c, float(c), c + 10.0) for c in range(cells)}


def test_what_is_refused(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        arrays.read_netcdf(b"\x89HDF\r\n\x1a\n" + b"\0" * 50)
    with pytest.raises(ValueError):
        arrays.read_netcdf(b"PAR1" + b"\0" * 50)
    with pytest.raises(NotImplementedError):
        arrays.decompress(b"x", {"id": "blosc"})
    with pytest.raises(FileNotFoundError):
        arrays.zarr_arrays(spark, str(tmp_path / "absent.zarr"))
    (tmp_path / "a.nc").write_bytes(run_file(T0))
    (tmp_path / "b.nc").write_bytes(arrays.write_netcdf({"x": 2}, {"v": arrays.Variable(("x",), {}, np.ones(2))}))
    with pytest.raises(ValueError, match="differ"):
        arrays.netcdf_cells(spark, [str(tmp_path / "a.nc"), str(tmp_path / "b.nc")])


def cube(spark):
    rows = [(T0 + timedelta(days=r), 21600 * s, p, None if (r, s, p) == (1, 0, 2) else float(r + s + p)) for r in range(2) for s in range(3) for p in range(4) if (r, s, p) != (0, 2, 3)]
    df = spark.createDataFrame(rows, "reference_time timestamp_ntz, lead_s bigint, point_index bigint, t double")
    places = spark.range(4).select(F.col("id").alias("point_index"), (F.col("id") + 50.0).alias("latitude"), (F.col("id") / 2).alias("longitude"))
    return Dataset(df.repartition(3), Properties(Space.POINT, Time.FORECAST), places)


@pytest.mark.parametrize("method", ["to_netcdf", "to_zarr"])
def test_datasets_round_trip(spark, tmp_path, method):
    ds = cube(spark)
    where = save_dataset(method, "fc", ds, f"{tmp_path}/{{name}}_{{year:int(%04d)}}" + (".zarr" if method == "to_zarr" else ""))
    back = load(spark, "cube", where if method == "to_zarr" else f"{where}/*.nc", **({} if method == "to_zarr" else {"fmt": "nc"}))
    assert back.is_forecast() and back.is_point()
    got = {(r.reference_time, r.lead_s, r.point_index): r.t for r in back.df.collect()}
    want = {(r.reference_time, r.lead_s, r.point_index): r.t for r in ds.df.collect()}
    assert {k: v for k, v in got.items() if k in want} == want and all(v is None for k, v in got.items() if k not in want) and len(got) == 24
    assert {r.point_index: (r.latitude, r.longitude) for r in back.places.collect()} == {p: (p + 50.0, p / 2) for p in range(4)}
    with pytest.raises(ValueError):
        save_dataset(method, "fc", ds.with_df(ds.df.withColumn("s", F.lit("text"))), str(tmp_path / "x"))


def store(folder, shape=(5, 3, 2, 7), chunks=(2, 3, 1, 4), consolidated=True, codec=None):
    """An analysis store, written plainly, without one of its chunks."""
    meta = {".zgroup": {"zarr_format": 2}, ".zattrs": {"variables": ["2t", "insolation", "10u"]}}
    rng = np.random.default_rng(4)
    data = rng.random(shape).astype("<f4")
    data[3, 0, 0, 1] = np.nan
    places = {"dates": (np.datetime64("2024-01-01T00", "s") + np.arange(shape[0]) * np.timedelta64(6, "h")).astype("<M8[s]"), "latitudes": np.arange(shape[3]).astype("<f8") + 40, "longitudes": np.arange(shape[3]).astype("<f8")}

    def put(path, raw):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(zlib.compress(raw) if codec else raw)

    for name, x, c in [("data", data, chunks), *[(k, v, (4,)) for k, v in places.items()]]:
        meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": list(x.shape), "chunks": list(c), "dtype": x.dtype.str, "compressor": codec, "fill_value": "NaN" if name == "data" else None, "order": "C", "filters": None}
        for at in np.ndindex(*[-(-n // k) for n, k in zip(x.shape, c, strict=True)]):
            part = x[tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, c, strict=True))]
            whole = np.zeros(c, x.dtype)
            whole[tuple(slice(0, n) for n in part.shape)] = part
            if (name, at) != ("data", (2, 0, 0, 1)):
                put(folder / name / ".".join(map(str, at)), whole.tobytes())
    for key, m in meta.items():
        (folder / key).parent.mkdir(parents=True, exist_ok=True)
        (folder / key).write_text(json.dumps(m))
    if consolidated:
        (folder / ".zmetadata").write_text(json.dumps({"metadata": meta}))
    data[4:, :, :1, 4:] = np.nan  # its chunk isn't there
    return data


@pytest.mark.parametrize(("consolidated", "codec"), [(True, None), (False, {"id": "zlib", "level": 1})])
def test_analysis_stores(spark, tmp_path, consolidated, codec):
    data = store(tmp_path / "a.zarr", consolidated=consolidated, codec=codec)
    ds = load(spark, "analysis", str(tmp_path / "a.zarr"), ["2t", "10u"])
    assert ds.is_grid() and ds.is_observation()
    got = {(r.valid_time, r.grid_index): (r["2t"], r["10u"]) for r in ds.df.collect()}
    plain = lambda x: None if np.isnan(x) else float(x)
    assert got == {(T0 + timedelta(hours=6 * t), c): (plain(data[t, 0, 0, c]), plain(data[t, 2, 0, c])) for t in range(5) for c in range(7)}
    assert {(r.grid_index, r.latitude, r.longitude) for r in ds.places.collect()} == {(c, 40.0 + c, float(c)) for c in range(7)}
    with pytest.raises(KeyError):
        load(spark, "analysis", str(tmp_path / "a.zarr"), "insolation")
