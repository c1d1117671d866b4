"""Writers of aligned datasets and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import fill
from ..model import Dataset
from .arrays import write_netcdf_files, write_zarr

#: Writers of tables by name; ``to_netcdf`` and ``to_zarr`` write arrays.
FORMATS = {"to_parquet": "parquet", "to_orc": "orc", "to_csv": "csv", "to_json": "json"}
ARRAYS = ("to_netcdf", "to_zarr")


def modal_date(axis: DataFrame, column: str) -> tuple[int, int, int]:
    """Most frequent year, its most frequent month, and that month's most frequent day; ties go to the smallest.

    Counts are of distinct axis values.  One row for each day reaches the driver at most.
    """
    days = axis.select(column).distinct().groupBy(F.year(column).alias("y"), F.month(column).alias("m"), F.dayofmonth(column).alias("d")).count()
    out: list[int] = []
    for c in ("y", "m", "d"):
        top = days.groupBy(c).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), c).first()
        if top is None:
            raise ValueError("no date")
        out.append(top[0])
        days = days.where(F.col(c) == top[0])
    return tuple(out)


def dataset_path(template: str, name: str, ds: Dataset) -> str:
    """``{name}``, ``{year}``, ``{month}`` and ``{day}`` filled in with the dataset's modal date."""
    values: dict = {"name": name}
    if any("{" + k in template for k in ("year", "month", "day")):
        values |= dict(zip(("year", "month", "day"), modal_date(ds.df, "reference_time" if ds.is_forecast() else "valid_time"), strict=True))
    return fill(template, values)


def write(method: str, df: DataFrame, path: str, **options) -> None:
    if method not in FORMATS:
        raise ValueError(f"unknown writer {method!r}; there are {', '.join([*sorted(FORMATS), *ARRAYS])}, the last two for datasets only")
    mode, by = options.pop("mode", "overwrite"), options.pop("partition_by", [])
    df.write.format(FORMATS[method]).mode(mode).options(**({"header": True} if method == "to_csv" else {}), **options).partitionBy(*([by] if isinstance(by, str) else by)).save(path)


def save_dataset(method: str, name: str, ds: Dataset, path: str, **options) -> str:
    """Write one dataset; the filled-in path comes back.

    ``to_netcdf`` makes a folder with a classic file for each value of the first key, ``to_zarr`` a
    store; both take the coordinates of places along.
    """
    where = dataset_path(path, name, ds)
    if method in ARRAYS:
        df, keys = ds.df, [k for k in ds.keys if not k.startswith(("latitude", "longitude"))]
        if ds.places is not None and ds.space_key:
            own = [c for c in ("longitude", "latitude") if c in ds.places.columns and c not in df.columns]
            df = df.join(ds.places.select(ds.space_key, *own), ds.space_key, "left")
        numbers = [c for c, t in df.dtypes if c in keys or t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith(("timestamp", "decimal"))]
        if left := [c for c in df.columns if c not in numbers]:
            raise ValueError(f"{method} writes numbers and times, not {', '.join(left)}")
        if method == "to_zarr":
            write_zarr(df, keys, where)
        else:
            write_netcdf_files(df, keys, where)
        return where
    write(method, ds.df, where, **options)
    return where


def save_metrics(method: str, metrics: DataFrame | None, path: str, **options) -> None:
    if metrics is None:
        raise ValueError("no metric was computed")
    write(method, metrics, path, **options)


def save_sets(sets: dict[str, Dataset], method: str, path: str, datasets: str = "all", **options) -> list[str]:
    """``all``: one output for each dataset; ``merge``: one, partitioned by ``model``."""
    if datasets == "all":
        return [save_dataset(method, k, d, path, **options) for k, d in sets.items()]
    if datasets == "merge":
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.df.withColumn("model", F.lit(k)) for k, d in sets.items()])
        first = next(iter(sets.values()))
        return [save_dataset(method, "merged", first.with_df(merged), path, **({"partition_by": "model"} | options))]
    raise ValueError(f"datasets is all or merge, not {datasets!r}")
