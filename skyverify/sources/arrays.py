"""Arrays in files as tables of cells: classic NetCDF files and Zarr stores (version 2), read and written.

Spark's own readers fetch all data, so any store that Spark knows will do.  A NetCDF file is one task's;
of a Zarr store it is the chunks with the same place in all variables.  The driver reads metadata,
and of Zarr stores the axes: the coordinates of dimensions, which are as long as the cube is wide.
Files of the HDF5 kind of NetCDF need a library that isn't required here and are refused.

A variable with fewer dimensions than the widest ones repeats along the others.  A dimension without
a coordinate is its ordinal.  Fill values and NaN are NULL, packed values are unpacked, times that
are counted since a date are timestamps, and ``lead_time`` is whole seconds.
"""

from __future__ import annotations

import bz2
import json
import lzma
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of classic NetCDF by number (fixed values).
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
_SINCE = re.compile(r"\s*(\w+)\s+since\s+(\d{4}-\d{1,2}-\d{1,2})(?:[T ]+(\d{1,2}:\d{2}(?::\d{2})?))?")
_UNITS = {"s": 1, "sec": 1, "second": 1, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400}
#: Rows of one Arrow batch.
ROWS = 100_000


def _seconds(unit: str) -> int | None:
    unit = unit.lower()
    return _UNITS.get(unit, _UNITS.get(unit.removesuffix("s")))


@dataclass
class Variable:
    dims: tuple[str, ...]
    attrs: dict
    values: np.ndarray

    def decoded(self, name: str) -> tuple[np.ndarray, np.ndarray | None]:
        """Values as they are meant, and where they are missing."""
        x, missing = self.values, None
        if x.dtype.kind in "SU":
            return x.astype(str).astype(object), None
        if x.dtype.kind == "M":
            return x.astype("datetime64[us]"), np.isnat(x)
        for key in ("_FillValue", "missing_value"):
            if (fill := self.attrs.get(key)) is not None and not isinstance(fill, str):
                at = x == np.asarray(fill).ravel()[0].astype(x.dtype)
                missing = at if missing is None else missing | at
        if "scale_factor" in self.attrs or "add_offset" in self.attrs:
            x = x * float(np.ravel(self.attrs.get("scale_factor", 1.0))[0]) + float(np.ravel(self.attrs.get("add_offset", 0.0))[0])
        units = str(self.attrs.get("units", ""))
        if (m := _SINCE.match(units)) and (by := _seconds(m[1])):
            start = np.datetime64(datetime.fromisoformat(f"{'-'.join(p.zfill(2) for p in m[2].split('-'))} {(m[3] or '00:00').zfill(5)}"), "us")
            return start + np.rint(np.asarray(x, np.float64) * by * 1e6).astype("timedelta64[us]"), missing
        if name == "lead_time":
            return np.rint(np.asarray(x, np.float64) * (_seconds(units) or 1)).astype(np.int64), missing
        if x.dtype.kind == "f":
            bad = np.isnan(x)
            return x.astype(np.float64), bad if missing is None else missing | bad
        return x.astype(np.int64), missing


def _column(x: np.ndarray, missing: np.ndarray | None) -> pa.Array:
    return pa.array(x, mask=missing) if x.dtype != object else pa.array(x.tolist(), pa.string())


_ARROW = {"f": pa.float64(), "i": pa.int64(), "u": pa.int64(), "b": pa.int64(), "M": pa.timestamp("us"), "O": pa.string()}
_SQL = {pa.float64(): "double", pa.int64(): "bigint", pa.timestamp("us"): "timestamp_ntz", pa.string(): "string"}


# --- classic NetCDF --------------------------------------------------------------------------


def read_netcdf(data: bytes) -> tuple[dict[str, int], dict, dict[str, Variable]]:
    """Dimensions, attributes and variables of a classic file's bytes."""
    if data[:8] == b"\x89HDF\r\n\x1a\n":
        raise NotImplementedError("a NetCDF file of the HDF5 kind; convert it to a classic one or to Zarr")
    if data[:3] != b"CDF" or data[3:4] not in (b"\1", b"\2", b"\5"):
        raise ValueError("no classic NetCDF file")
    wide, at = data[3] == 5, 4
    offset = "q" if data[3] != 1 else "i"

    def number(kind: str | None = None) -> int:
        nonlocal at
        kind = kind or ("q" if wide else "i")
        (x,) = struct.unpack_from(f">{kind}", data, at)
        at += struct.calcsize(kind)
        return x

    def chunk(n: int) -> bytes:
        nonlocal at
        out = data[at : at + n]
        at += -(-n // 4) * 4
        return out

    def name() -> str:
        return chunk(number()).decode()

    def attributes() -> dict:
        tag, n = number("i"), number()
        out = {}
        for _ in range(n if tag == _ATTRIBUTE else 0):
            key, kind, size = name(), np.dtype(_TYPES[number("i")]), number()
            raw = chunk(size * kind.itemsize)
            out[key] = raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind)
        return out

    records, tag, n = number(), number("i"), number()
    dims = [(name(), number()) for _ in range(n if tag == _DIMENSION else 0)]
    attrs = attributes()
    tag, n = number("i"), number()
    found = []
    for _ in range(n if tag == _VARIABLE else 0):
        key, ids = name(), [number() for _ in range(number())]
        own, kind, size, begin = attributes(), np.dtype(_TYPES[number("i")]), number(), number(offset)
        found.append((key, ids, own, kind, size, begin))
    growing = [f for f in found if f[1] and dims[f[1][0]][1] == 0]
    step = sum(-(-int(np.prod([dims[i][1] for i in f[1][1:]], dtype=np.int64)) * f[3].itemsize // 4) * 4 for f in growing)
    if len(growing) == 1:  # then records aren't padded
        step = int(np.prod([dims[i][1] for i in growing[0][1][1:]], dtype=np.int64)) * growing[0][3].itemsize
    if records < 0:
        records = (len(data) - min(f[5] for f in growing)) // max(step, 1) if growing else 0
    sizes = {k: n or records for k, n in dims}
    out = {}
    for key, ids, own, kind, _, begin in found:
        shape = [dims[i][1] or records for i in ids]
        if ids and dims[ids[0]][1] == 0:
            one = int(np.prod(shape[1:], dtype=np.int64))
            values = np.concatenate([np.frombuffer(data, kind, one, begin + r * step) for r in range(records)]) if records else np.zeros(0, kind)
        else:
            values = np.frombuffer(data, kind, int(np.prod(shape, dtype=np.int64)), begin)
        values, ids = values.reshape(shape), [dims[i][0] for i in ids]
        if kind.kind == "S" and values.ndim:  # texts of a fixed length
            values, ids = np.ascontiguousarray(values).view(f"S{shape[-1]}")[..., 0] if shape[-1] else values[..., 0], ids[:-1]
        out[key] = Variable(tuple(ids), own, values)
    return sizes, attrs, out


def write_netcdf(dims: dict[str, int], variables: dict[str, Variable], attrs: dict | None = None) -> bytes:
    """A classic file with 64-bit offsets; doubles, 32-bit integers and texts."""

    def named(x: str) -> bytes:
        raw = x.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attributes(a: dict) -> bytes:
        items = []
        for k, v in a.items():
            raw = v.encode() if isinstance(v, str) else np.asarray(v, ">f8").ravel().tobytes()
            items.append(named(k) + struct.pack(">ii", 2 if isinstance(v, str) else 6, len(raw) if isinstance(v, str) else len(raw) // 8) + raw + b"\0" * (-len(raw) % 4))
        return listed(_ATTRIBUTE, items)

    names, bodies = list(dims), []
    for v in variables.values():
        kind = 6 if v.values.dtype.kind == "f" else 4
        raw = np.ascontiguousarray(v.values, _TYPES[kind]).tobytes()
        bodies.append((kind, raw + b"\0" * (-len(raw) % 4)))

    def header(begins: list[int]) -> bytes:
        items = [named(k) + struct.pack(f">i{len(v.dims)}i", len(v.dims), *map(names.index, v.dims)) + attributes(v.attrs) + struct.pack(">iiq", kind, min(len(raw), 2**31 - 4), begin) for (k, v), (kind, raw), begin in zip(variables.items(), bodies, begins, strict=True)]
        return b"CDF\2" + struct.pack(">i", 0) + listed(_DIMENSION, [named(k) + struct.pack(">i", n) for k, n in dims.items()]) + attributes(attrs or {}) + listed(_VARIABLE, items)

    start = len(header([0] * len(bodies)))
    begins = [start + sum(len(raw) for _, raw in bodies[:k]) for k in range(len(bodies))]
    return header(begins) + b"".join(raw for _, raw in bodies)


def cells_of(sizes: dict[str, int], variables: dict[str, Variable], first: dict[str, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the widest variables: a column for each dimension and variable.  ``first`` has ordinals that dimensions begin with."""
    dims = max((v.dims for k, v in variables.items() if k not in sizes), key=len, default=())
    values = {k: v for k, v in variables.items() if k not in sizes and set(v.dims) <= set(dims) and v.dims}
    shape = [sizes[d] for d in dims]
    columns = {}
    for k, d in enumerate(dims):
        at = (first or {}).get(d, 0)
        x, missing = variables[d].decoded(d) if d in variables and variables[d].dims == (d,) else (np.arange(at, at + sizes[d]), None)
        columns[d] = (x, missing, (k,))
    for name, v in values.items():
        order = sorted(range(len(v.dims)), key=lambda i: dims.index(v.dims[i]))
        x, missing = v.decoded(name)
        columns[name] = (x.transpose(order), None if missing is None else missing.transpose(order), tuple(sorted(dims.index(d) for d in v.dims)))
    n = int(np.prod(shape, dtype=np.int64))
    for a in range(0, n, ROWS):
        at = np.unravel_index(np.arange(a, min(a + ROWS, n)), shape)
        yield pa.RecordBatch.from_arrays([_column(x[tuple(at[i] for i in on)], None if m is None else m[tuple(at[i] for i in on)]) for x, m, on in columns.values()], names=list(columns))


def _schema(sizes: dict[str, int], variables: dict[str, Variable]) -> str:
    """DDL of ``cells_of``'s columns."""
    one = {k: Variable(v.dims, v.attrs, v.values.reshape(-1)[:1].reshape([1] * len(v.dims)) if v.values.size else np.zeros([1] * len(v.dims), v.values.dtype)) for k, v in variables.items()}
    row = next(cells_of(dict.fromkeys(sizes, 1), one))
    return ", ".join(f"`{f.name}` {_SQL[_ARROW[{pa.float64(): 'f', pa.int64(): 'i', pa.string(): 'O'}.get(f.type, 'M')]]}" for f in row.schema)


def netcdf_cells(spark: SparkSession, paths: list[str], file_column: str | None = None) -> DataFrame:
    """Cells of classic NetCDF files, which must have the same variables; ``file_column`` names the file."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for data in rows.column(1).to_pylist():
                sizes, _, variables = read_netcdf(data)
                yield pa.RecordBatch.from_arrays([pa.array([_schema(sizes, variables)])], names=["ddl"])

    kinds = [r[0] for r in files.mapInArrow(describe, "ddl string").distinct().limit(2).collect()]
    if not kinds:
        raise FileNotFoundError(", ".join(paths))
    if len(kinds) > 1:
        raise ValueError(f"files differ in their variables: {kinds[0]} and {kinds[1]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                sizes, _, variables = read_netcdf(data)
                for out in cells_of(sizes, variables):
                    yield out.append_column(file_column, pa.array([path] * out.num_rows)) if file_column else out

    return files.mapInArrow(run, kinds[0] + (f", `{file_column}` string" if file_column else ""))


# --- Zarr ------------------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _load(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes, or None if it isn't there."""
    where, store = _hadoop(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def decompress(data: bytes, codec: dict | None) -> bytes:
    if codec is None:
        return data
    kind = codec["id"]
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    if kind == "bz2":
        return bz2.decompress(data)
    if kind == "lzma":
        return lzma.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    try:
        import numcodecs
    except ImportError as e:
        raise NotImplementedError(f"chunks compressed by {kind!r} need the package numcodecs") from e
    return bytes(numcodecs.get_codec(codec).decode(data))


@dataclass(frozen=True)
class ZarrArray:
    """What a store says of an array."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    dims: tuple[str, ...]
    attrs: dict
    codec: dict | None
    fill: object
    order: str
    separator: str

    def chunk(self, data: bytes | None, at: tuple[int, ...]) -> np.ndarray:
        """A chunk's values within the array; all missing if it was never written."""
        kind = np.dtype(self.dtype)
        if data is None:
            values = np.full(self.chunks, np.nan if self.fill is None and kind.kind == "f" else self.fill or 0, kind)
        else:
            values = np.frombuffer(decompress(data, self.codec), kind).reshape(self.chunks, order=self.order)
        return values[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(at, self.chunks, self.shape, strict=True))]

    def variable(self, values: np.ndarray) -> Variable:
        fill = {} if self.fill is None or isinstance(self.fill, str) else {"_FillValue": self.fill}
        return Variable(self.dims, fill | self.attrs, values)


def zarr_arrays(spark: SparkSession, store: str) -> tuple[dict[str, ZarrArray], dict]:
    """Arrays and attributes of a store."""
    store = store.rstrip("/")
    whole = _load(spark, f"{store}/.zmetadata")
    if whole:
        meta = json.loads(whole)["metadata"]
    else:
        where, files = _hadoop(spark, store)
        if not files.exists(where):
            raise FileNotFoundError(store)
        names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
        wanted = [".zattrs", *[f"{n}/{f}" for n in names for f in (".zarray", ".zattrs")]]
        meta = {k: json.loads(raw) for k in wanted if (raw := _load(spark, f"{store}/{k}"))}
    out = {}
    for key, m in meta.items():
        if not key.endswith("/.zarray"):
            continue
        name = key.removesuffix("/.zarray")
        if m.get("filters"):
            raise NotImplementedError(f"{name}: filters {m['filters']}")
        attrs = dict(meta.get(f"{name}/.zattrs", {}))
        dims = attrs.pop("_ARRAY_DIMENSIONS", None) or [f"{name}_{k}" for k in range(len(m["shape"]))]
        fill = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}.get(m["fill_value"], m["fill_value"]) if isinstance(m["fill_value"], str) else m["fill_value"]
        out[name] = ZarrArray(tuple(m["shape"]), tuple(max(c, 1) for c in m["chunks"]), m["dtype"], tuple(dims), attrs, m.get("compressor"), fill, m.get("order", "C"), m.get("dimension_separator", "."))
    return out, meta.get(".zattrs", {})


def zarr_axis(spark: SparkSession, store: str, name: str, array: ZarrArray) -> Variable:
    """A whole array of one dimension, read by the driver."""
    count = -(-array.shape[0] // array.chunks[0])
    parts = [array.chunk(_load(spark, f"{store.rstrip('/')}/{name}/{k}"), (k,)) for k in range(count)]
    return array.variable(np.concatenate(parts) if parts else np.zeros(0, array.dtype))


def zarr_cells(spark: SparkSession, store: str, arrays: dict[str, ZarrArray] | None = None, axes: dict[str, Variable] | None = None) -> DataFrame:
    """Cells of a store's widest arrays, whose chunks must be alike, with the one-dimensional ones beside them.

    ``axes`` gives coordinates of dimensions that the store has otherwise.
    """
    store = store.rstrip("/")
    arrays = arrays or zarr_arrays(spark, store)[0]
    wide = {k: a for k, a in arrays.items() if k not in a.dims and len(a.dims) == max(len(b.dims) for b in arrays.values())}
    first = next(iter(wide.values()))
    for k, a in wide.items():
        if (a.dims, a.shape, a.chunks) != (first.dims, first.shape, first.chunks):
            raise NotImplementedError(f"{k}: arrays of a store must have the same dimensions and chunks")
    known = {d: zarr_axis(spark, store, d, arrays[d]) for d in first.dims if d in arrays and arrays[d].dims == (d,)} | (axes or {})
    grid = [-(-n // c) for n, c in zip(first.shape, first.chunks, strict=True)]
    chunks = int(np.prod(grid, dtype=np.int64))
    # every chunk's number, with the files of all arrays that have it
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{store}/{k}" for k in wide])
    key = F.regexp_extract("path", r"([^/]+)/([0-9][0-9./]*)$", 2)
    parts = F.split(F.translate(key, "/", "."), r"\.")
    number = F.lit(0).cast("long")
    for k, n in enumerate(grid):
        number = number * n + F.element_at(parts, k + 1).cast("long")
    have = files.select(number.alias("chunk"), F.regexp_extract("path", r"([^/]+)/[0-9][0-9./]*$", 1).alias("array"), "content").where("chunk IS NOT NULL")
    rows = spark.range(chunks).select(F.col("id").alias("chunk"), F.lit("").alias("array"), F.lit(None).cast("binary").alias("content")).unionByName(have)
    empty = {k: a.variable(np.zeros([1] * len(a.dims), a.dtype)) for k, a in wide.items()}
    ddl = _schema(dict.fromkeys(first.dims, 1), empty | {d: Variable((d,), v.attrs, v.values[:1]) for d, v in known.items()})

    def run(table: pa.Table) -> pa.Table:
        at = tuple(int(i) for i in np.unravel_index(table.column("chunk")[0].as_py(), grid))
        data = dict(zip(table.column("array").to_pylist(), table.column("content").to_pylist(), strict=True))
        begin = {d: i * c for d, i, c in zip(first.dims, at, first.chunks, strict=True)}
        found = {k: a.variable(a.chunk(data.get(k), at)) for k, a in wide.items()}
        sizes = dict(zip(first.dims, next(iter(found.values())).values.shape, strict=True))
        for d, v in known.items():
            found[d] = Variable((d,), v.attrs, v.values[begin[d] : begin[d] + sizes[d]])
        return pa.Table.from_batches(list(cells_of(sizes, found, begin)))

    cells = rows.groupBy("chunk").applyInArrow(run, ddl)
    for name, a in arrays.items():
        if len(a.dims) == 1 and a.dims[0] in first.dims and name != a.dims[0] and a.dims[0] not in known:
            beside = zarr_column(spark, store, name, a)
            cells = cells.join(beside, a.dims[0])
    return cells


def zarr_column(spark: SparkSession, store: str, name: str, a: ZarrArray) -> DataFrame:
    """A one-dimensional array as a table of its dimension's ordinal and value."""
    ddl = f"`{a.dims[0]}` bigint, `{name}` {_SQL[_ARROW[np.dtype(a.dtype).kind]]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                k = int(path.rsplit("/", 1)[1])
                values = a.chunk(data, (k,))
                x, missing = a.variable(values).decoded(name)
                begin = k * a.chunks[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + len(x))), _column(x, missing)], names=[a.dims[0], name])

    return spark.read.format("binaryFile").load(f"{store}/{name}").select("path", "content").mapInArrow(run, ddl)


def analysis_cells(spark: SparkSession, store: str) -> DataFrame:
    """The long table of an analysis store: an array ``data`` by date, variable, member and cell, with ``dates``, ``latitudes``, ``longitudes``."""
    arrays, attrs = zarr_arrays(spark, store)
    dims = {"data": ("dates", "variable", "ensemble", "cell"), "dates": ("dates",), "latitudes": ("cell",), "longitudes": ("cell",)}
    arrays = {k: replace(arrays[k], dims=d) for k, d in dims.items()}
    named = Variable(("variable",), {}, np.array(attrs["variables"], dtype="S"))
    return zarr_cells(spark, store, arrays, {"variable": named}).select("dates", "variable", "ensemble", "cell", "data", "longitudes", "latitudes")


# --- writers ---------------------------------------------------------------------------------


def _epoch(x: pd.Series) -> np.ndarray:
    return x.astype("datetime64[us]").to_numpy().astype("datetime64[s]").astype(np.int64)


def _as_variable(name: str, dims: tuple[str, ...], values: np.ndarray) -> Variable:
    if values.dtype.kind == "M":
        return Variable(dims, {"units": "seconds since 1970-01-01 00:00:00"}, values.astype("datetime64[s]").astype(np.int64).astype(np.float64))
    whole = values.dtype.kind in "iu" and (not len(values) or max(abs(int(values.min())), abs(int(values.max()))) < 2**31)
    return Variable(dims, {"units": "seconds"} if name == "lead_time" else {}, values.astype(np.int32 if whole else np.float64))


def write_netcdf_files(df: DataFrame, keys: list[str], folder: str) -> list[str]:
    """One classic file for each value of the first key, a task each; the paths come back.

    Files are cubes over the other keys, dense within a file.  They get their names when they are whole.
    """
    first, rest = keys[0], keys[1:]
    names = [c for c in df.columns if c not in keys]
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(root, recursive=True)
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        label = {"lead_s": "lead_time"}
        axes = [np.sort(rows[k].unique()) for k in keys]
        place = [np.searchsorted(a, rows[k].to_numpy(a.dtype)) for a, k in zip(axes, keys, strict=True)]
        dims = {label.get(k, k): len(a) for k, a in zip(keys, axes, strict=True)}
        variables = {label.get(k, k): _as_variable(label.get(k, k), (label.get(k, k),), a.astype("datetime64[us]") if kinds[k].startswith("timestamp") else a) for k, a in zip(keys, axes, strict=True)}
        for c in names:
            cube = np.full([len(a) for a in axes], np.nan)
            x = rows[c]
            cube[tuple(place)] = _epoch(x).astype(float) if kinds[c].startswith("timestamp") else pd.to_numeric(x).to_numpy(float, na_value=np.nan)
            variables[c] = Variable(tuple(dims), {"units": "seconds since 1970-01-01 00:00:00"} if kinds[c].startswith("timestamp") else {}, cube)
        tag = re.sub(r"[^0-9A-Za-z]+", "", str(pd.Timestamp(axes[0][0]).isoformat()) if kinds[first].startswith("timestamp") else str(axes[0][0]))
        to, where = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        path = f"{where}/{first}-{tag}.nc"
        with to.open_output_stream(f"{path}.part") as out:
            out.write(write_netcdf(dims, variables))
        to.move(f"{path}.part", path)
        return pd.DataFrame({"path": [path]})

    return sorted(r[0] for r in df.select(*keys, *[F.col(f"`{c}`") for c in names]).groupBy(first).applyInPandas(run, "path string").collect())


def write_zarr(df: DataFrame, keys: list[str], store_path: str) -> None:
    """A store of the dense cube over ``keys``, a chunk for each value of all keys but the last, written by tasks.

    The driver gets the axes.  Chunks are compressed by zlib.  Cells that aren't there are NaN.
    """
    uri = store_path if "://" in store_path else f"file://{store_path}"
    store, root = fs.FileSystem.from_uri(uri)
    names, kinds = [c for c in df.columns if c not in keys], dict(df.dtypes)
    label = {k: "lead_time" if k == "lead_s" else k for k in keys}
    sets = df.agg(*[F.sort_array(F.collect_set(k)).alias(k) for k in keys]).first()
    axes = {k: (np.array(sets[k], "datetime64[us]").astype("datetime64[s]").astype(np.int64) if kinds[k].startswith("timestamp") else np.array(sets[k])) for k in keys}
    units = {k: "seconds since 1970-01-01 00:00:00" if kinds[k].startswith("timestamp") else "seconds" if k == "lead_s" else "" for k in [*keys, *names]}
    shape = [len(axes[k]) for k in keys]
    meta: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": {}}

    def described(name: str, dims: list[str], size: list[int], chunks: list[int], unit: str, kind: str = "<f8") -> None:
        meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": size, "chunks": chunks, "dtype": kind, "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN" if kind == "<f8" else None, "order": "C", "filters": None}
        meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims} | ({"units": unit} if unit else {})

    for k in keys:
        described(label[k], [label[k]], [len(axes[k])], [max(1, len(axes[k]))], units[k], "<i8" if axes[k].dtype.kind in "iu" else "<f8")
    for c in names:
        described(c, [label[k] for k in keys], shape, [1] * (len(keys) - 1) + [max(1, shape[-1])], units[c])
    store.create_dir(root, recursive=True)

    def put(to: fs.FileSystem, path: str, data: bytes) -> None:
        to.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with to.open_output_stream(path) as out:
            out.write(data)

    for k in keys:
        put(store, f"{root}/{label[k]}/0", zlib.compress(axes[k].astype("<i8" if axes[k].dtype.kind in "iu" else "<f8").tobytes(), 1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        to, where = fs.FileSystem.from_uri(uri)
        plain = {k: _epoch(rows[k]) if kinds[k].startswith("timestamp") else rows[k].to_numpy() for k in keys}
        at = [int(np.searchsorted(axes[k], plain[k][0])) for k in keys[:-1]]
        place = np.searchsorted(axes[keys[-1]], plain[keys[-1]])
        for c in names:
            line = np.full(shape[-1], np.nan)
            line[place] = _epoch(rows[c]).astype(float) if kinds[c].startswith("timestamp") else pd.to_numeric(rows[c]).to_numpy(float, na_value=np.nan)
            put(to, f"{where}/{c}/{'.'.join(map(str, [*at, 0]))}", zlib.compress(line.astype("<f8").tobytes(), 1))
        return pd.DataFrame({"cells": [len(rows)]})

    df.select(*keys, *[F.col(f"`{c}`") for c in names]).groupBy(*keys[:-1]).applyInPandas(run, "cells long").agg(F.sum("cells")).collect()
    for key, m in meta.items():
        put(store, f"{root}/{key}", json.dumps(m).encode())
    put(store, f"{root}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}).encode())
