"""Classic CDF files (the published CDF-1, CDF-2 and CDF-5 formats): header parser, writer, and a Spark data source.

spark.read.format("meshfield_cdf").option("variable", name).load(path) gives one row per value: file, idx (array of indices), value.
Headers alone are read on the driver; values are read by tasks that hold a range of the leading dimension each. Filters on t_idx (the leading index) choose ranges.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: nc_type -> numpy type. Fixed by the format.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {np.dtype(v): k for k, v in KINDS.items()}
NAMES = {1: "byte", 2: "char", 3: "short", 4: "int", 5: "float", 6: "double", 7: "ubyte", 8: "ushort", 9: "uint", 10: "int64", 11: "uint64"}
_DIMS, _VARS, _ATTS = 10, 11, 12
#: Values of one task.
CHUNK = 1_000_000


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    attrs: dict
    begin: int = 0
    record: bool = False


@dataclass
class Header:
    version: int
    n_records: int
    dims: dict[str, int] = field(default_factory=dict)
    unlimited: str | None = None
    attrs: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    record_size: int = 0


class _Scanner:
    def __init__(self, data: bytes, version: int):
        self.data, self.at, self.wide = data, 4, version == 5
        self.offset = ">i4" if version == 1 else ">i8"

    def number(self, kind: str) -> int:
        size = np.dtype(kind).itemsize
        if self.at + size > len(self.data):
            raise EOFError
        v = int(np.frombuffer(self.data, kind, 1, self.at)[0])
        self.at += size
        return v

    def size(self) -> int:
        return self.number(">i8" if self.wide else ">i4")

    def name(self) -> str:
        return self.raw(self.size()).decode()

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        out = self.data[self.at : self.at + n]
        self.at += n + -n % 4
        return out

    def attrs(self) -> dict:
        tag, n = self.number(">i4"), self.size()
        if tag not in (0, _ATTS):
            raise ValueError("attribute list expected")
        out = {}
        for _ in range(n):
            key, kind, count = self.name(), self.number(">i4"), self.size()
            raw = self.raw(count * np.dtype(KINDS[kind]).itemsize)
            v = np.frombuffer(raw, KINDS[kind], count)
            out[key] = raw.decode(errors="replace").rstrip("\0") if kind == 2 else v[0].item() if count == 1 else v.tolist()
        return out


def parse_header(data: bytes) -> Header:
    """Header from a file's first bytes; EOFError where they are too few."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("no classic CDF file")
    s = _Scanner(data, data[3])
    n = s.number(">i8" if s.wide else ">i4")
    h = Header(data[3], max(n, 0))
    tag, count = s.number(">i4"), s.size()
    names = []
    for _ in range(count):
        name, size = s.name(), s.size()
        names.append(name)
        h.dims[name] = size or h.n_records
        if not size:
            h.unlimited = name
    h.attrs = s.attrs()
    tag, count = s.number(">i4"), s.size()
    for _ in range(count):
        name = s.name()
        ids = [s.size() for _ in range(s.size())]
        attrs, kind = s.attrs(), s.number(">i4")
        s.size()
        begin = s.number(s.offset)
        dims = tuple(names[i] for i in ids)
        v = Variable(name, dims, tuple(h.dims[d] for d in dims), np.dtype(KINDS[kind]), attrs, begin, bool(dims) and dims[0] == h.unlimited)
        h.variables[name] = v
    sizes = [_slab(v) for v in h.variables.values() if v.record]
    h.record_size = sizes[0] if len(sizes) == 1 else sum(x + -x % 4 for x in sizes)
    return h


def _slab(v: Variable) -> int:
    """Bytes of one record, or of the whole variable without records."""
    return int(np.prod(v.shape[1:] if v.record else v.shape, dtype=np.int64)) * v.dtype.itemsize


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI (file, s3, gs, hdfs, ...) and the path in it: driver and tasks read the same way."""
    path = path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _opened(path: str):
    store, inner = place_of(path)
    return store.open_input_file(inner)


def read_header(path: str) -> Header:
    size = 1 << 14
    while True:
        with _opened(path) as f:
            data = f.read(size)
        try:
            return parse_header(data)
        except EOFError:
            if len(data) < size:
                raise
            size *= 4


def read_values(path: str, h: Header, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values of rows start to stop of the leading dimension (all of a scalar)."""
    v = h.variables[name]
    if not v.shape:
        with _opened(path) as f:
            f.seek(v.begin)
            return np.frombuffer(f.read(v.dtype.itemsize), v.dtype).reshape(())
    stop = v.shape[0] if stop is None else stop
    row = int(np.prod(v.shape[1:], dtype=np.int64)) * v.dtype.itemsize
    with _opened(path) as f:
        if v.record:
            parts = []
            for k in range(start, stop):
                f.seek(v.begin + k * h.record_size)
                parts.append(f.read(row))
            raw = b"".join(parts)
        else:
            f.seek(v.begin + start * row)
            raw = f.read((stop - start) * row)
    return np.frombuffer(raw, v.dtype).reshape(stop - start, *v.shape[1:])


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def write(path: str, dims: Mapping[str, int | None], variables: Mapping[str, tuple[Sequence[str], np.ndarray, Mapping]], attrs: Mapping | None = None, version: int = 2) -> None:
    """A classic file (K-01, K-02). dims: None for the unlimited one. variables: name -> (dims, values, attributes)."""
    wide = version == 5
    size = lambda n: struct.pack(">q" if wide else ">i", n)
    name = lambda s: size(len(s.encode())) + _pad(s.encode())
    order = list(dims)
    unlimited = next((d for d in order if dims[d] is None), None)
    arrays = {k: (tuple(d), _coded(a), dict(at)) for k, (d, a, at) in variables.items()}
    n_rec = max([a.shape[0] for d, a, _ in arrays.values() if d and d[0] == unlimited] or [0])

    def attr_list(at: Mapping) -> bytes:
        if not at:
            return struct.pack(">i", 0) + size(0)
        out = struct.pack(">i", _ATTS) + size(len(at))
        for k, v in at.items():
            if isinstance(v, str):
                raw, kind, n = v.encode(), 2, len(v.encode())
            else:
                a = _coded(np.atleast_1d(np.asarray(v)))
                raw, kind, n = a.tobytes(), CODES[a.dtype], len(a)
            out += name(k) + struct.pack(">i", kind) + size(n) + _pad(raw)
        return out

    def header(begins: Mapping[str, int]) -> bytes:
        out = b"CDF" + bytes([version]) + size(n_rec)
        out += struct.pack(">i", _DIMS if dims else 0) + size(len(dims)) + b"".join(name(d) + size(dims[d] or 0) for d in order)
        out += attr_list(attrs or {}) + struct.pack(">i", _VARS if arrays else 0) + size(len(arrays))
        for k, (d, a, at) in arrays.items():
            own = a[:1].nbytes if d and d[0] == unlimited else a.nbytes
            out += name(k) + size(len(d)) + b"".join(size(order.index(x)) for x in d) + attr_list(at)
            out += struct.pack(">i", CODES[a.dtype]) + size(min(own + -own % 4, 2**31 - 1 if not wide else 2**63 - 1)) + struct.pack(">i" if version == 1 else ">q", begins[k])
        return out

    begins = dict.fromkeys(arrays, 0)
    at = len(header(begins))
    for k, (d, a, _) in arrays.items():
        if not (d and d[0] == unlimited):
            begins[k], at = at, at + len(_pad(a.tobytes()))
    records = [k for k, (d, _, _) in arrays.items() if d and d[0] == unlimited]
    for k in records:
        begins[k] = at
        own = arrays[k][1][:1].nbytes
        at += own if len(records) == 1 else own + -own % 4
    store, inner = place_of(path)
    with store.open_output_stream(inner) as f:
        f.write(header(begins))
        for k, (_, a, _) in arrays.items():
            if k not in records:
                f.write(_pad(a.tobytes()))
        for r in range(n_rec):
            for k in records:
                raw = arrays[k][1][r : r + 1].tobytes()
                f.write(raw if len(records) == 1 else _pad(raw))


def _coded(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a)
    if a.dtype == bool:
        a = a.astype("i1")
    if a.dtype.kind == "U":
        a = a.astype("S1")
    if a.dtype.kind == "i" and a.dtype.itemsize == 8 and (not a.size or abs(a).max() < 2**31):
        a = a.astype("i4")
    return a if a.dtype.kind == "S" else a.astype(a.dtype.newbyteorder(">"))


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    stop: int
    base: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.variable = options.get("variable")
        self.lo, self.hi = 0, 2**62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("t_idx",):
                if isinstance(f, In):
                    lo, hi = (min(f.value), max(f.value)) if f.value else (1, 0)
                else:
                    lo = f.value if isinstance(f, EqualTo | GreaterThanOrEqual) else f.value + 1 if isinstance(f, GreaterThan) else None
                    hi = f.value if isinstance(f, EqualTo | LessThanOrEqual) else f.value - 1 if isinstance(f, LessThan) else None
                self.lo = self.lo if lo is None else max(self.lo, int(lo))
                self.hi = self.hi if hi is None else min(self.hi, int(hi))
            yield f  # Spark tests them again

    def partitions(self) -> list[InputPartition]:
        parts, base = [], 0
        for path in self.paths:
            v = read_header(path).variables[self.variable]
            n = v.shape[0] if v.shape else 1
            step = max(1, CHUNK // max(1, int(np.prod(v.shape[1:], dtype=np.int64))))
            lo, hi = max(0, self.lo - base), min(n - 1, self.hi - base)
            parts += [_Part(path, k, min(k + step, hi + 1), base) for k in range(lo, hi + 1, step)]
            base += n
        return parts or [_Part("", 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.stop <= part.start:
            return
        h = read_header(part.path)
        v = h.variables[self.variable]
        a = read_values(part.path, h, self.variable, part.start, part.stop)
        fill = v.attrs.get("_FillValue", v.attrs.get("missing_value"))
        flat = a.reshape(-1).astype(np.float64) if v.dtype.kind != "S" else np.array([ord(x or b"\0") for x in a.reshape(-1)], np.float64)
        idx = np.stack(np.unravel_index(np.arange(flat.size), a.shape or (1,)), 1).astype(np.int32)
        idx[:, 0] += part.start + part.base
        gone = np.zeros(flat.size, bool) if fill is None else flat == np.float64(fill)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, idx.size + 1, idx.shape[1]), pa.int32()), pa.array(idx.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * flat.size, pa.string()), pa.array(idx[:, 0], pa.int32()), lists, pa.array(flat, mask=gone)], names=["file", "t_idx", "idx", "value"])


class CdfSource(DataSource):
    """S-01, S-06"""

    @classmethod
    def name(cls) -> str:
        return "meshfield_cdf"

    def schema(self) -> str:
        return "file string, t_idx int, idx array<int>, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and turns on the session's filter pushdown to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CdfSource)


def load_variable(spark: SparkSession, path: str | Sequence[str], name: str) -> DataFrame:
    """One variable of one file, or of several joined along their leading dimension (file order): t_idx goes on from file to file."""
    register(spark)
    paths = [str(path)] if isinstance(path, str) or not isinstance(path, Sequence) else [str(p) for p in path]
    return spark.read.format("meshfield_cdf").option("paths", json.dumps(paths)).option("variable", name).load().drop("file")


def metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """nc_dimension, nc_variable and the global attributes (S-03, S-35) from the header alone."""
    h = read_header(path)
    dims = spark.createDataFrame([(k, v, k == h.unlimited) for k, v in h.dims.items()], "name string, size long, unlimited boolean")
    text = lambda at: {k: v if isinstance(v, str) else json.dumps(v) for k, v in at.items()}
    rows = [(v.name, NAMES[CODES[v.dtype]], list(v.dims), list(v.shape), text(v.attrs)) for v in h.variables.values()]
    return dims, spark.createDataFrame(rows, "name string, dtype string, dims array<string>, shape array<long>, attrs map<string,string>"), text(h.attrs)
