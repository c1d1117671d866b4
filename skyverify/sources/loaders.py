"""Loaders: files become datasets with traits, validated, with missing values as NULL.

``cube`` reads any table of cells and infers its traits; ``analysis`` reads long tables of
(date, variable, member, cell, value); ``runs`` reads forecast runs; ``stations`` reads a SQLite
table of station records.  Tables are plain Spark scans, so column selection and filters reach the
files; paths that end in ``.nc`` or ``.zarr`` are read as arrays.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from contextlib import closing
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ATTRIBUTES, KEYS, Dataset, Properties, Space, Time, infer_properties, validate, without_nan
from ..operators.space_alignment import add_crs, add_grid_mapping
from .arrays import analysis_cells, netcdf_cells, zarr_cells

_LOADERS: dict[str, Callable] = {}

#: Inputs of forecast models that an analysis store holds beside its variables (fixed values).
FORCING_VARIABLES = (
    "latitude",
    "longitude",
    "time",
    "cos_julian_day",
    "cos_latitude",
    "cos_local_time",
    "cos_longitude",
    "insolation",
    "sin_julian_day",
    "sin_latitude",
    "sin_local_time",
    "sin_longitude",
)


def register_loader(name: str):
    """Register a function of (spark, files, variables, **options) that gives a dataset."""

    def add(fn):
        _LOADERS[name] = fn
        return fn

    return add


def available_loaders() -> list[str]:
    return sorted(_LOADERS)


def get_loader(name: str) -> Callable:
    if name not in _LOADERS:
        raise ValueError(f"unknown loader {name!r}; there are {', '.join(available_loaders())}")
    return _LOADERS[name]


def load(spark: SparkSession, name: str, files: str | list[str], variables: str | list[str] | None = None, grid_mapping: str | dict | None = None, **options) -> Dataset:
    """Load, select variables, validate; a preset as ``grid_mapping`` gives projection and grid."""
    loader = get_loader(name)
    paths = [files] if isinstance(files, str) else list(files)
    names = [variables] if isinstance(variables, str) else variables
    ds = loader(spark, paths, names, **options)
    if names:
        ds = ds.select(names)
    ds = ds.with_df(without_nan(ds.df, ds.variables))
    validate(ds)
    if grid_mapping is not None:
        if isinstance(grid_mapping, str):
            ds = add_crs(ds, grid_mapping)
        ds = add_grid_mapping(ds, grid_mapping)
    return ds


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that are there, by the file system that Spark reads them with; each once."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        return found is not None and len(found) > 0

    return [p for p in dict.fromkeys(paths) if there(p)]


def scan(spark: SparkSession, paths: list[str], fmt: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON, classic NetCDF or Zarr by ``fmt`` or the first path's ending."""
    if fmt is None:
        end = paths[0].rstrip("/").rpartition(".")[2].lower()
        fmt = end if end in ("orc", "csv", "json", "nc", "zarr") else "parquet"
    if fmt == "nc":
        return netcdf_cells(spark, paths)
    if fmt == "zarr":
        return reduce(DataFrame.unionByName, [zarr_cells(spark, p) for p in paths])
    if fmt == "csv":
        options = {"header": True, "inferSchema": "schema" not in options} | options
    schema = options.pop("schema", None)
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(paths)


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _leads(df: DataFrame) -> DataFrame:
    """A ``lead_time`` column as whole seconds ``lead_s``."""
    if "lead_time" not in df.columns or "lead_s" in df.columns:
        return df
    kind = dict(df.dtypes)["lead_time"]
    seconds = F.expr("cast(extract(DAY FROM lead_time) * 86400 + extract(HOUR FROM lead_time) * 3600 + extract(MINUTE FROM lead_time) * 60 + extract(SECOND FROM lead_time) as bigint)") if kind.startswith("interval") else F.col("lead_time").cast("long")
    return df.withColumn("lead_s", seconds).drop("lead_time")


def _natural(column: str) -> Column:
    """A sort key of text whose runs of digits count as numbers, so that u9 comes before u10."""

    def part(x: Column) -> Column:
        digits = F.when(x.rlike("^[0-9]"), F.ltrim(x, F.lit("0")))
        return F.struct(F.when(digits.isNull(), x).otherwise("").alias("text"), F.coalesce(F.length(digits), F.lit(0)).alias("size"), F.coalesce(digits, F.lit("")).alias("digits"))

    return F.transform(F.regexp_extract_all(F.col(column), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part)


def ordinal(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` with its rank from 0, numbers in text by their size; of a table of places, not of cells."""
    order = [_natural(column), F.col(column)] if dict(df.dtypes)[column] == "string" else [F.col(column)]
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def split_places(df: DataFrame, key: str, columns: tuple[str, ...] = ("longitude", "latitude", *ATTRIBUTES)) -> tuple[DataFrame, DataFrame | None]:
    """Cells without coordinates, and the table of places."""
    own = [c for c in columns if c in df.columns]
    if not own:
        return df, None
    return df.drop(*own), df.select(key, *own).groupBy(key).agg(*[F.min(c).alias(c) for c in own])


@register_loader("cube")
def cube(spark: SparkSession, paths: list[str], variables: list[str] | None = None, places: str | DataFrame | None = None, **options) -> Dataset:
    """Tables of cells with columns named as in ``KEYS``; a station ``code`` becomes ``point_index``."""
    df = _leads(_ntz(scan(spark, paths, **options)))
    if "code" in df.columns and "point_index" not in df.columns:
        df = df.join(ordinal(df.select("code").distinct(), "code", "point_index"), "code")
    if variables:
        keep = [c for c in df.columns if c in KEYS or c in ATTRIBUTES or c in variables]
        df = df.select(*keep, *[v for v in variables if v not in df.columns and _missing(v)])
    props = infer_properties(df.columns)
    key = next((k for k in ("grid_index", "point_index") if k in df.columns), None)
    table = spark.read.parquet(places) if isinstance(places, str) else places
    if key and table is None:
        df, table = split_places(df, key)
    return Dataset(df, props, table)


def _ends(path: str, suffix: str) -> bool:
    return path.rstrip("/").lower().endswith(suffix)


def _missing(name: str):
    raise KeyError(f"no such variable: {name}")


@register_loader("analysis")
def analysis(spark: SparkSession, paths: list[str], variables: list[str] | None = None, member: int = 0, **options) -> Dataset:
    """Long tables (dates, variable, ensemble, cell, data, longitudes, latitudes) of one or more stores.

    Member ``member`` stays and its key goes; forcing variables can't be had.  Without ``variables``
    the names are looked up first, since a pivot needs them.
    """
    parts = [analysis_cells(spark, p) if _ends(p, ".zarr") else _ntz(scan(spark, [p], **options)) for p in paths]
    return analysis_dataset(reduce(DataFrame.unionByName, parts), variables, member)


def analysis_dataset(long: DataFrame, variables: list[str] | None = None, member: int = 0) -> Dataset:
    """A long table as a grid of observations; see ``analysis``."""
    long = long.where((F.col("ensemble") == member) & ~F.col("variable").isin(*FORCING_VARIABLES))
    names = variables or [r[0] for r in long.select("variable").distinct().orderBy("variable").collect()]
    long = long.withColumnsRenamed({"dates": "valid_time", "cell": "grid_index", "longitudes": "longitude", "latitudes": "latitude"})
    if unknown := [v for v in names if v in FORCING_VARIABLES]:
        raise KeyError(f"no such variable: {', '.join(unknown)}")
    wide = long.where(F.col("variable").isin(*names)).groupBy("valid_time", "grid_index").pivot("variable", names).agg(F.first("data"))
    place = [F.min(F.col(c).cast("float").cast("double")).alias(c) for c in ("longitude", "latitude")]
    return Dataset(wide, Properties(Space.GRID, Time.OBSERVATION), long.groupBy("grid_index").agg(*place))


@register_loader("runs")
def runs(spark: SparkSession, paths: list[str], variables: list[str] | None = None, run_column: str | None = None, **options) -> Dataset:
    """Forecast runs: columns time, values (the cell), longitude, latitude, variables.

    A run is a file, or what shares ``run_column``.  Its first time is the reference time and leads
    count from it.
    """
    if run_column is None and _ends(paths[0], ".nc"):
        df, run_column = netcdf_cells(spark, paths, "run_file"), "run_file"
    elif run_column is None and _ends(paths[0], ".zarr"):
        df, run_column = reduce(DataFrame.unionByName, [zarr_cells(spark, p).withColumn("run_file", F.lit(p)) for p in paths]), "run_file"
    else:
        df = _ntz(scan(spark, paths, **options))
    if run_column is None:
        df, run_column = df.withColumn("run_file", F.input_file_name()), "run_file"
    return run_dataset(df, run_column, variables)


def run_dataset(df: DataFrame, run_column: str, variables: list[str] | None = None) -> Dataset:
    """Forecast runs told apart by ``run_column``; see ``runs``."""
    df = df.withColumnRenamed(run_column, "_run")
    first = df.groupBy("_run").agg(F.min("time").alias("reference_time"))
    df = df.join(first, "_run").withColumn("lead_s", F.timestamp_diff("SECOND", F.col("reference_time"), F.col("time")))
    df = df.drop("_run", "time").withColumnRenamed("values", "grid_index").withColumn("grid_index", F.col("grid_index").cast("long"))
    if variables:
        df = df.select(*[c for c in df.columns if c in KEYS or c in variables], *[v for v in variables if v not in df.columns and _missing(v)])
    df, places = split_places(df, "grid_index", ("longitude", "latitude"))
    order = [c for c in ("reference_time", "lead_s", "grid_index") if c in df.columns]
    return Dataset(df.select(*order, *[c for c in df.columns if c not in order]), Properties(Space.GRID, Time.FORECAST), places)


def densify(obs: DataFrame, place: str, time: str = "valid_time") -> DataFrame:
    """Every place at every time that occurs; a repeated key is a ValueError."""
    if not obs.groupBy(place, time).count().where("count > 1").isEmpty():
        raise ValueError(f"several records for one {place} and {time}")
    return obs.select(place).distinct().crossJoin(obs.select(time).distinct()).join(obs, [place, time], "left")


def station_places(records: DataFrame, code: str = "SID") -> DataFrame:
    """One row for each station with the least of each coordinate, numbered by code from 0."""
    table = records.groupBy(F.col(code).alias("code")).agg(F.min("lat").alias("latitude"), F.min("lon").alias("longitude"), F.min("elev").alias("elevation"))
    return ordinal(table, "code", "point_index")


def station_dataset(records: DataFrame, dense: bool = True) -> Dataset:
    """Records (SID, validdate in Unix seconds, lat, lon, elev, variables) as observations at points."""
    names = [c for c in records.columns if c not in ("SID", "validdate", "lat", "lon", "elev")]
    places = station_places(records)
    obs = records.select(F.col("SID").alias("code"), F.timestamp_seconds("validdate").cast("timestamp_ntz").alias("valid_time"), *[F.col(f"`{n}`") for n in names])
    obs = obs.join(places.select("code", "point_index"), "code").drop("code")
    return Dataset(densify(obs, "point_index") if dense else obs, Properties(Space.POINT, Time.OBSERVATION), places)


@register_loader("stations")
def stations(spark: SparkSession, paths: list[str], variables: list[str] | None = None, table: str = "SYNOP", dense: bool = True) -> Dataset:
    """One SQLite file, of at most 2 GB, which an executor reads."""
    if len(paths) != 1:
        raise NotImplementedError("only one station file at a time")
    coords = ("SID", "validdate", "lat", "lon", "elev")
    file = spark.read.format("binaryFile").load(paths[0]).select("content")

    def opened(data: bytes) -> sqlite3.Connection:
        db = sqlite3.connect(":memory:")
        db.deserialize(data)
        return db

    def describe(batches):
        for rows in batches:
            for data in rows.column(0).to_pylist():
                with closing(opened(data)) as db:
                    names = [d[0] for d in db.execute(f'SELECT * FROM "{table}" LIMIT 0').description]
                    kind = db.execute(f'SELECT typeof(SID) FROM "{table}" LIMIT 1').fetchone()
                yield pa.RecordBatch.from_arrays([pa.array([names]), pa.array([bool(kind and kind[0] == "text")])], names=["names", "text"])

    have, text = file.mapInArrow(describe, "names array<string>, text boolean").first()
    names = [c for c in have if c not in coords]
    for v in variables or ():
        if v not in names:
            _missing(v)
    wanted = [*coords, *(variables or names)]
    types = [pa.string() if text else pa.int64(), pa.int64(), *[pa.float64()] * (len(wanted) - 2)]

    def read(batches):
        for rows in batches:
            for data in rows.column(0).to_pylist():
                with closing(opened(data)) as db:
                    cursor = db.execute("SELECT " + ", ".join(f'"{c}"' for c in wanted) + f' FROM "{table}"')
                    while some := cursor.fetchmany(50_000):
                        columns = zip(*some, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([None if x is None else float(x) for x in c] if t == pa.float64() else c, t) for c, t in zip(columns, types, strict=True)], names=wanted)

    schema = ", ".join(f"`{c}` {'string' if t == pa.string() else 'bigint' if t == pa.int64() else 'double'}" for c, t in zip(wanted, types, strict=True))
    return station_dataset(without_nan(file.mapInArrow(read, schema), wanted[2:]), dense)
