"""Gridded cubes in the classic NetCDF format and in NetCDF-4 (HDF5), as a Spark data source that reads by range.

spark.dataSource.register(CubeSource); spark.read.format("climate_cube").load("file:///x.nc") gives
(variable, t, row, col, value): the only variable over (time, lat, lon) in any order of its
dimensions' usual names, missing values as null. Tasks read runs of months, of whole chunks where a
file is chunked; the options `first` and `last` bound the steps (last is left out), and no task is made
nor chunk read outside them.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.calendars import time_axis
from . import hdf5
from .files import opened

TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
TIME, LAT, LON = ("time", "t"), ("lat", "latitude", "y"), ("lon", "longitude", "x")
STEPS = 12


class Header:
    """Dimensions, attributes and variables of a classic file (versions 1 and 2)."""

    def __init__(self, f):
        self.data, self.at, self.f = b"", 0, f
        magic = self._take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.wide = magic[3] == 2
        self.records = self._int()
        self.dims = self._list(lambda: (self._name(), self._int()))
        self.attrs = dict(self._list(self._attr))
        self.vars = {}
        for name, dims, attrs, kind, size, begin in self._list(self._var):
            self.vars[name] = (dims, dict(attrs), kind, size, begin)
        record = [v for v in self.vars.values() if v[0] and self.dims[v[0][0]][1] == 0]
        self.record_size = sum(v[3] for v in record)
        if len(record) == 1:  # a sole record variable isn't padded
            dims, _, kind, _, _ = record[0]
            self.record_size = int(np.prod([self.dims[d][1] for d in dims[1:]], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize

    def _take(self, n):
        while len(self.data) < self.at + n:
            more = self.f.read_at(1 << 16, len(self.data))
            if not more:
                raise ValueError("file ends in its header")
            self.data += more
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def _int(self):
        return struct.unpack(">I", self._take(4))[0]

    def _name(self):
        n = self._int()
        return self._take(n + -n % 4)[:n].decode()

    def _list(self, item):
        self._int()
        return [item() for _ in range(self._int())]

    def _attr(self):
        name, kind, n = self._name(), self._int(), self._int()
        raw = self._take(n * np.dtype(TYPES[kind]).itemsize + -(n * np.dtype(TYPES[kind]).itemsize) % 4)
        value = raw[:n].decode("latin-1") if kind == 2 else np.frombuffer(raw, TYPES[kind], n)
        return name, value

    def _var(self):
        name = self._name()
        dims = [self._int() for _ in range(self._int())]
        attrs = self._list(self._attr)
        return name, dims, attrs, self._int(), self._int(), struct.unpack(">Q", self._take(8))[0] if self.wide else self._int()

    def size(self, dim):
        return self.dims[dim][1] or self.records

    def field(self) -> str:
        """The only variable over time, latitude and longitude."""
        names = [{self.dims[d][0].lower() for d in v[0]} for v in self.vars.values()]
        found = [k for k, s in zip(self.vars, names) if len(s) == 3 and all(s & set(x) for x in (TIME, LAT, LON))]
        if len(found) != 1:
            raise ValueError(f"needs one variable over time, lat and lon, has {found}")
        return found[0]

    def axis(self, names) -> np.ndarray | None:
        """Values of a coordinate variable."""
        for k, (dims, _, kind, _, begin) in self.vars.items():
            if k.lower() in names and len(dims) == 1 and self.dims[dims[0]][1]:
                t = np.dtype(TYPES[kind])
                return np.frombuffer(self.f.read_at(t.itemsize * self.size(dims[0]), begin), t).astype(float)
        return None

    def times(self) -> tuple[np.ndarray | None, str, str]:
        """(values, units, calendar) of the time axis."""
        for k, (dims, attrs, kind, _, begin) in self.vars.items():
            if k.lower() in TIME and len(dims) == 1:
                t = np.dtype(TYPES[kind])
                if self.dims[dims[0]][1]:
                    raw = self.f.read_at(t.itemsize * self.size(dims[0]), begin)
                else:
                    raw = b"".join(self.f.read_at(t.itemsize, begin + i * self.record_size) for i in range(self.records))
                return np.frombuffer(raw, t), attrs.get("units", ""), attrs.get("calendar", "standard")
        return None, "", "standard"

    def run(self) -> int:
        """Steps that are read best together."""
        return 1

    def length(self) -> int:
        """Steps of the field."""
        return next(self.size(d) for d in self.vars[self.field()][0] if self.dims[d][0].lower() in TIME)

    def steps(self, name: str, first: int, last: int) -> np.ndarray:
        """(time, lat, lon) of steps first..last - 1; missing and fill values are NaN."""
        dims, attrs, kind, _, begin = self.vars[name]
        t = np.dtype(TYPES[kind])
        order = [next(i for i, d in enumerate(dims) if self.dims[d][0].lower() in x) for x in (TIME, LAT, LON)]
        shape = [self.size(d) for d in dims]
        if order[0] == 0:
            each = int(np.prod(shape[1:], dtype=np.int64)) * t.itemsize
            stride = self.record_size if self.dims[dims[0]][1] == 0 else each
            if stride == each:
                raw = self.f.read_at(each * (last - first), begin + first * each)
            else:
                raw = b"".join(self.f.read_at(each, begin + k * stride) for k in range(first, last))
            values = np.frombuffer(raw, t).reshape(last - first, *shape[1:])
        else:
            values = np.frombuffer(self.f.read_at(int(np.prod(shape, dtype=np.int64)) * t.itemsize, begin), t).reshape(shape)
            values = np.take(values, range(first, last), order[0])
        values = np.transpose(values, order)
        out = values.astype(np.float64)
        for key in ("_FillValue", "missing_value"):
            if key in attrs:
                out[values == attrs[key][0]] = np.nan
        scale, shift = (float(attrs[k][0]) if k in attrs else d for k, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + shift if (scale, shift) != (1.0, 0.0) else out


def header(f):
    """The header of a file, classic or HDF5."""
    return hdf5.File(f) if f.read_at(8, 0) == hdf5.SIGNATURE else Header(f)


class Steps(InputPartition):
    def __init__(self, path, name, first, last):
        self.path, self.name, self.first, self.last = path, name, first, last


class CubeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.expect = options.get("path"), options.get("steps")
        self.first, self.last = int(options.get("first") or 0), options.get("last")

    def partitions(self):
        with opened(self.path) as f:
            head = header(f)
            name, n, run = head.field(), head.length(), head.run()
        if self.expect and int(self.expect) != n:
            raise ValueError(f"{self.path} has {n} steps, not {self.expect}")
        # Whole chunks along time, at least STEPS steps a task.
        step = run * max(1, STEPS // run)
        first, last = max(0, self.first), min(n, int(self.last) if self.last is not None else n)
        return [Steps(self.path, name, max(first, a), min(last, a + step)) for a in range(first - first % step, last, step)]

    def read(self, partition):
        with opened(partition.path) as f:
            head = header(f)
            run = head.run()
            for t in range(partition.first, partition.last):
                if t == partition.first or t % run == 0:  # a run of chunks at a time
                    begin, held = t, head.steps(partition.name, t, min(partition.last, t - t % run + run))
                values = held[t - begin]
                row, col = np.indices(values.shape)
                flat = values.ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.array([partition.name] * flat.size), pa.array(np.full(flat.size, t, np.int32)), pa.array(row.ravel().astype(np.int32)), pa.array(col.ravel().astype(np.int32)), pa.array(flat, mask=~np.isfinite(flat)),
                ], names=["variable", "t", "row", "col", "value"])


class CubeSource(DataSource):
    @classmethod
    def name(cls):
        return "climate_cube"

    def schema(self):
        return "variable string, t int, row int, col int, value double"

    def reader(self, schema):
        return CubeReader(self.options)


def read_cube(spark, path: str, steps: int | None = None, first: int | None = None, last: int | None = None):
    """(variable, t, row, col, value) of a cube, of its steps first..last - 1; steps: the number of months it must have."""
    spark.dataSource.register(CubeSource)
    reader = spark.read.format("climate_cube")
    for key, value in (("steps", steps), ("first", first), ("last", last)):
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)


class Description:
    """What a cube's header says: the variable's name, coordinates, and (year, month, day) of every step."""

    def __init__(self, name: str, lons: list[float], lats: list[float], dates: list[tuple[int, int, int]]):
        self.name, self.lons, self.lats, self.dates = name, lons, lats, dates


def describe(path: str) -> Description:
    """A cube's Description; a cube without coordinates or a time axis with units is an error."""
    with opened(path) as f:
        head = header(f)
        lons, lats, (values, units, calendar) = head.axis(LON), head.axis(LAT), head.times()
        if lons is None or lats is None or values is None:
            raise ValueError(f"{path} has no lon, lat and time axes")
        dates = time_axis(values.tolist(), units, calendar)
        if len(dates) != head.length():
            raise ValueError(f"{path} has {len(dates)} times for {head.length()} steps")
        return Description(head.field(), lons.tolist(), lats.tolist(), dates)


def axes(path: str) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(longitudes, latitudes) of a cube's coordinate variables."""
    with opened(path) as f:
        head = header(f)
        return head.axis(LON), head.axis(LAT)
