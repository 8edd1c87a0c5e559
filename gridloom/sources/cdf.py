"""Classic array files, versions 1, 2 and 5: header codec, and a data source that reads and writes variables.

The header is read on the driver; data are read by byte ranges, a partition for each run of whole rows of the first
axis, and decoded with numpy into Arrow batches. :func:`box` reads only the rows of the first axis that a box has, by bounds given as options.
Filters are not pushed down by Spark's own way: in Spark 4.1.2 those of one query stay with a Python source and thin later queries of the same table.

Data are written in parallel, by each task at the places of its cells, into a file laid out beforehand. That takes a file system that can be
written at any place and is mounted on every machine.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.functions.types import BY_CODE, TYPES
from gridloom.operators.fill import fill_column, fill_value, grid
from gridloom.operators.select import validate, vars_
from gridloom.plans.catalog import Attr, Dataset, Dim, Schema, Var, attr_bytes
from gridloom.plans.errors import ArrayError

# Fixed values of the format: list tags.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


class _Out:
    """Big-endian header fields; counts take 8 bytes in version 5, else 4."""

    def __init__(self, version: int):
        self.parts: list[bytes] = []
        self.wide = version == 5

    def raw(self, data: bytes) -> None:
        self.parts.append(data + b"\0" * (-len(data) % 4))

    def int4(self, x: int) -> None:
        self.parts.append(struct.pack(">I", x))

    def count(self, x: int) -> None:
        self.parts.append(struct.pack(">Q" if self.wide else ">I", x))

    def name(self, text: str) -> None:
        data = text.encode()
        self.count(len(data))
        self.raw(data)

    def listed(self, tag: int, n: int) -> None:
        self.int4(tag if n else 0)
        self.count(n)


def _put_attrs(out: _Out, attrs: dict[str, Attr]) -> None:
    out.listed(ATTRIBUTE, len(attrs))
    for name, (kind, values) in attrs.items():
        out.name(name)
        out.int4(TYPES[kind].code)
        data = values[0].encode() if kind == "char" else np.array(values, TYPES[kind].numpy).tobytes()
        out.count(len(data) if kind == "char" else len(values))
        out.raw(data)


def encode_header(schema: Schema, begins: dict[str, int] | None = None) -> bytes:
    out = _Out(schema.version)
    out.parts.append(b"CDF" + bytes([schema.version]))
    out.count(schema.numrecs)
    out.listed(DIMENSION, len(schema.dims))
    for d in schema.dims:
        out.name(d.name)
        out.count(0 if d.unlimited else d.size)
    _put_attrs(out, schema.attrs)
    out.listed(VARIABLE, len(schema.vars))
    for v in schema.vars:
        out.name(v.name)
        out.count(len(v.dims))
        for d in v.dims:
            out.count(d)
        _put_attrs(out, v.attrs)
        out.int4(TYPES[v.kind].code)
        size = schema.var_bytes(v)
        out.count(size if out.wide or size < 2**32 else 2**32 - 1)
        begin = (begins or {}).get(v.name, 0)
        out.parts.append(struct.pack(">I" if schema.version == 1 else ">Q", begin))
    return b"".join(out.parts)


def header_size(schema: Schema) -> int:
    return len(encode_header(schema))


class _In:
    def __init__(self, data: bytes):
        self.data, self.pos, self.wide, self.issues = data, 0, False, []

    def take(self, n: int) -> bytes:
        if self.pos + n > len(self.data):
            raise ArrayError("NC_ENOTNC", f"header ends at byte {len(self.data)}, {n} more expected at {self.pos}")
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def int4(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">Q", self.take(8))[0] if self.wide else self.int4()

    def padded(self, n: int) -> bytes:
        data, pad = self.take(n), self.take(-n % 4)
        if pad.strip(b"\0"):
            self.issues.append((self.pos, "padding is not zero"))
        return data

    def name(self) -> str:
        try:
            return self.padded(self.count()).decode()
        except UnicodeDecodeError:
            raise ArrayError("NC_EBADNAME", f"at byte {self.pos}") from None

    def listed(self, tag: int) -> int:
        found, n = self.int4(), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ArrayError("NC_ENOTNC", f"tag {found} at byte {self.pos}, {tag} expected")
        return n


def _kind(code: int, pos: int) -> str:
    if code not in BY_CODE:
        raise ArrayError("NC_EBADTYPE", f"{code} at byte {pos}")
    return BY_CODE[code].name


def _get_attrs(src: _In) -> dict[str, Attr]:
    out: dict[str, Attr] = {}
    for _ in range(src.listed(ATTRIBUTE)):
        name, kind = src.name(), _kind(src.int4(), src.pos)
        n = src.count()
        data = src.padded(n * TYPES[kind].size)
        out[name] = (kind, (data.decode("utf-8", "replace"),) if kind == "char" else tuple(np.frombuffer(data, TYPES[kind].numpy).tolist()))
    return out


@dataclass
class Header:
    schema: Schema
    begins: dict[str, int]
    vsizes: dict[str, int]
    size: int
    issues: list[tuple[int, str]]


def decode_header(data: bytes) -> Header:
    src = _In(data)
    if src.take(3) != b"CDF" or (version := src.take(1)[0]) not in (1, 2, 5):
        raise ArrayError("NC_ENOTNC", "magic")
    src.wide = version == 5
    records = src.count()
    schema = Schema(version)
    for _ in range(src.listed(DIMENSION)):
        name, n = src.name(), src.count()
        schema.dims.append(Dim(name, n, n == 0))
    if sum(d.unlimited for d in schema.dims) > 1:
        raise ArrayError("NC_EUNLIMIT")
    schema.attrs = _get_attrs(src)
    begins, vsizes = {}, {}
    for _ in range(src.listed(VARIABLE)):
        name = src.name()
        ids = [src.count() for _ in range(src.count())]
        if any(d >= len(schema.dims) for d in ids):
            raise ArrayError("NC_EBADDIM", name)
        attrs = _get_attrs(src)
        kind = _kind(src.int4(), src.pos)
        vsizes[name] = src.count()
        begins[name] = src.int4() if version == 1 else struct.unpack(">Q", src.take(8))[0]
        schema.vars.append(Var(name, kind, ids, attrs, no_fill="_FillValue" not in attrs))
    schema.numrecs, schema.defining = records, False
    return Header(schema, begins, vsizes, src.pos, src.issues)


#: First read of a header, and the growth of the next ones.
CHUNK = 256 << 10


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def read_header(path: str) -> Header:
    """The header of a file, read in chunks that grow until it is whole."""
    fs, at = _fs(path)
    if fs.get_file_info(at).type != pafs.FileType.File:
        raise ArrayError("NC_ENOENT", path)
    size, n = fs.get_file_info(at).size, CHUNK
    with fs.open_input_file(at) as f:
        while True:
            try:
                return decode_header(f.read_at(min(n, size), 0))
            except ArrayError:
                if n >= size:
                    raise
                n *= 4


def _recsize(schema: Schema) -> int:
    return schema.layout()[1]


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``last`` of a variable's first axis."""

    first: int
    last: int


class CdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.name = options["path"], options["variable"]
        header = read_header(self.path)
        s = header.schema
        self.shape, self.kind, self.begin = s.shape(self.name), s.var(self.name).kind, header.begins[self.name]
        row = prod(self.shape[1:]) * TYPES[self.kind].size
        self.step = _recsize(s) if s.is_record(self.name) else row
        self.row = row
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", 2**62))
        self.bytes = int(options.get("partition_bytes", 64 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        if not self.shape:
            return [Rows(0, 1)]
        low, high = max(0, self.low), min(self.shape[0], self.high)
        step = max(1, self.bytes // max(self.step, 1))
        return [Rows(i, min(i + step, high)) for i in range(low, high, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, at = _fs(self.path)
        numpy_type = TYPES[self.kind].numpy
        n, width = len(self.shape), prod(self.shape[1:])
        size = fs.get_file_info(at).size
        rows_a_read = max(1, (4 << 20) // max(self.row, 1))
        with fs.open_input_file(at) as f:
            for first in range(partition.first, partition.last, rows_a_read):
                last = min(first + rows_a_read, partition.last)
                if self.step == self.row or not self.shape:
                    data = f.read_at((last - first) * self.row, self.begin + first * self.step)
                else:
                    data = b"".join(f.read_at(self.row, self.begin + r * self.step) for r in range(first, last))
                data += b"\0" * ((last - first) * self.row - len(data)) if size else b""
                flat = np.frombuffer(data, numpy_type)
                place = np.arange(first * width, first * width + len(flat))
                index = np.unravel_index(place, (max(last, 1), *self.shape[1:])) if n else ()
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in index], _to_arrow(flat, self.kind)], [*[f"d{i}" for i in range(n)], "value"])


def _to_arrow(flat: np.ndarray, kind: str) -> pa.Array:
    if kind == "char":
        return pa.array([x.decode("latin-1") if x else "\x00" for x in flat.tolist()], pa.string())
    target = {"byte": "i1", "short": "i2", "int": "i4", "float": "f4", "double": "f8", "ubyte": "i2", "ushort": "i4", "uint": "i8", "int64": "i8"}
    if kind == "uint64":
        return pa.array(flat.astype(np.uint64)).cast(pa.decimal128(20, 0))
    return pa.array(flat.astype(target[kind]))


class CdfSource(DataSource):
    """``spark.read.format("cdf").option("variable", name).load(path)``: one variable in long form.

    ``df.write.format("cdf").option("variable", name).option("type", kind).option("shape", "0,20").save(path)`` writes a file
    of one variable; length 0 of the first axis makes it a record axis, whose length is the option ``records``. Modes: error, overwrite.
    """

    @classmethod
    def name(cls) -> str:
        return "cdf"

    def schema(self) -> T.StructType:
        v = read_header(self.options["path"]).schema.var(self.options["variable"])
        return T.StructType([*[T.StructField(f"d{i}", T.LongType()) for i in range(len(v.dims))], T.StructField("value", TYPES[v.kind].spark)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CdfReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return CdfWriter(dict(self.options), overwrite)


def box(spark: SparkSession, path: str, name: str, start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None, **options) -> DataFrame:
    """A strided box of a variable of a file, re-based; of the first axis only the rows from the box's first to its last are read."""
    spark.dataSource.register(CdfSource)
    s = read_header(path).schema
    validate(s.shape(name), start, count, stride, record=s.is_record(name), numrecs=s.numrecs, version=s.version)
    if start:
        first, n = start[0], count[0]
        options |= {"from": first, "to": first + (n - 1) * (stride[0] if stride else 1) + 1 if n else first}
    return vars_(spark.read.format("cdf").options(variable=name, **options).load(path), start, count, stride)


@dataclass(frozen=True)
class Place:
    """Where a variable's cells are in a file."""

    path: str
    kind: str
    shape: tuple[int, ...]
    begin: int
    #: Bytes from one index of the first axis to the next.
    step: int

    @classmethod
    def of(cls, schema: Schema, name: str, path: str, begins: dict[str, int], recsize: int) -> Place:
        kind, shape = schema.var(name).kind, tuple(schema.shape(name))
        return cls(path, kind, shape, begins[name], recsize if schema.is_record(name) else prod(shape[1:]) * TYPES[kind].size)

    def put(self, batch: pa.RecordBatch) -> None:
        """Writes the cells (d0.., value) of a batch, each run of neighbouring places at once; a null leaves its place as it is."""
        batch = batch.filter(batch.column("value").is_valid())
        n, size = batch.num_rows, TYPES[self.kind].size
        if not n:
            return
        place = np.zeros(n, np.int64)
        for i in range(1, len(self.shape)):
            place = place * self.shape[i] + batch.column(f"d{i}").to_numpy()
        at = self.begin + (batch.column("d0").to_numpy() * self.step if self.shape else 0) + place * size
        value = batch.column("value")
        if self.kind == "char":
            flat = np.array([x.encode("latin-1") for x in value.to_pylist()], "S1")
        elif self.kind == "uint64":
            flat = np.array([int(x) for x in value.to_pylist()], ">u8")
        else:
            flat = value.to_numpy(zero_copy_only=False).astype(TYPES[self.kind].numpy)
        order = np.argsort(at, kind="stable")
        at, flat = at[order], flat[order]
        ends = np.append(np.flatnonzero(np.diff(at) != size) + 1, n)
        with open(self.path, "r+b") as f:
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                f.seek(int(at[a]))
                f.write(flat[a:b].tobytes())

    def put_all(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As ``mapInArrow`` wants it; no rows come out."""
        for b in batches:
            self.put(b)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["done"])


def _lay_out(schema: Schema, path: str, **align: int) -> tuple[str, dict[str, int], int]:
    """A new file of full length beside ``path`` with the header of ``schema`` in it, where variables begin, and the bytes of a record."""
    begins, recsize = schema.layout(**align)
    fs, at = _fs(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ArrayError("NC_EINVAL", f"{path}: a file system that can be written at any place is needed")
    fixed = [begins[v.name] + schema.var_bytes(v) for v in schema.vars if not schema.is_record(v.name)]
    records = [begins[v.name] for v in schema.vars if schema.is_record(v.name)]
    header = encode_header(schema, begins)
    end = max([len(header), *fixed, *([min(records) + schema.numrecs * recsize] if records else [])])
    temporary = f"{at}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "wb") as f:
        f.write(header)
        f.truncate(end)
    return temporary, begins, recsize


class CdfWriter(DataSourceArrowWriter):
    """Writes a file of one variable: tasks write their cells, the commit gives the file its name, an abort removes it."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        if not overwrite and os.path.exists(_fs(self.path)[1]):
            raise ArrayError("NC_EEXIST", self.path)
        shape = [int(x) for x in options.get("shape", "").split(",") if x.strip()]
        schema = Schema(int(options.get("version", 5)))
        for i, n in enumerate(shape):
            schema.def_dim(f"d{i}", n)
        schema.def_var(options["variable"], options.get("type", "double"), list(range(len(shape))))
        schema.enddef()
        if shape and shape[0] == 0:
            schema.numrecs = int(options.get("records", 0))
        self.temporary, begins, recsize = _lay_out(schema, self.path)
        self.place = Place.of(schema, options["variable"], self.temporary, begins, recsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        for b in iterator:
            self.place.put(b)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.replace(self.temporary, _fs(self.path)[1])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        os.remove(self.temporary)


def open_dataset(spark: SparkSession, path: str, **options) -> Dataset:
    """All variables of a file; nothing but the header is read."""
    spark.dataSource.register(CdfSource)
    header = read_header(path)
    frames = {v.name: spark.read.format("cdf").options(variable=v.name, **options).load(path) for v in header.schema.vars}
    return Dataset(header.schema, frames)


def write_dataset(dataset: Dataset, path: str, *, clobber: bool = True, h_align: int = 4, v_align: int = 4, r_align: int = 4) -> None:
    """Writes a dataset as one classic file: laid out on the driver, filled and written by tasks, then given its name."""
    fs, at = _fs(path)
    if not clobber and fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise ArrayError("NC_EEXIST", path)
    schema = dataset.schema
    if schema.defining:
        schema.enddef()
    dataset.sync_numrecs()
    temporary, begins, recsize = _lay_out(schema, path, h_align=h_align, v_align=v_align, r_align=r_align)
    try:
        for v in schema.vars:
            place, data = Place.of(schema, v.name, temporary, begins, recsize), dataset.data.get(v.name)
            if not v.no_fill and prod(place.shape) and data is not None:
                _run(grid(data.sparkSession, place.shape).withColumn("value", fill_column(v.kind, fill_value(v.kind, v.attrs.get("_FillValue")))), place)
            if data is not None:
                # Ranges of places, in order, so that a task writes long runs.
                index = [f"d{i}" for i in range(len(place.shape))]
                _run(data.repartitionByRange(*index).sortWithinPartitions(*index) if index else data, place)
        os.replace(temporary, at)
    finally:
        if os.path.exists(temporary):  # abort: nothing half-written stays
            os.remove(temporary)


def _run(cells: DataFrame, place: Place) -> None:
    cells = cells.select(*[F.col(f"d{i}").cast("long").alias(f"d{i}") for i in range(len(place.shape))], F.col("value").cast(TYPES[place.kind].spark).alias("value"))
    cells.mapInArrow(place.put_all, "done long").write.format("noop").mode("overwrite").save()


def delete(path: str) -> None:
    fs, at = _fs(path)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        raise ArrayError("NC_ENOENT", path)
    fs.delete_file(at)


def validate_file(path: str) -> list[tuple[str, str]]:
    """(code, detail) of everything wrong with a file's header and layout."""
    try:
        header = read_header(path)
    except ArrayError as e:
        return [(e.name, str(e))]
    s = header.schema
    found = [("NC_ENOTNC", f"{what} before byte {pos}") for pos, what in header.issues]
    ordered = sorted(s.vars, key=lambda v: header.begins[v.name])
    end, last = header.size, "the header"
    for v in ordered:
        if header.begins[v.name] < end:
            found.append(("NC_ENOTNC", f"{v.name} begins at {header.begins[v.name]}, within {last}"))
        if any(s.dims[d].unlimited for d in v.dims[1:]):
            found.append(("NC_EUNLIMPOS", v.name))
        if header.vsizes[v.name] != min(s.var_bytes(v), 2**32 - 1 if s.version < 5 else 2**63):
            found.append(("NC_EVARSIZE", f"{v.name} states {header.vsizes[v.name]} bytes, its shape needs {s.var_bytes(v)}"))
        end, last = header.begins[v.name] + s.var_bytes(v), v.name
    return found


def offsets_report(path: str) -> list[dict]:
    """For each variable by its place: begin, end, size, and the gap before it."""
    header = read_header(path)
    rows, end = [], header.size
    for v in sorted(header.schema.vars, key=lambda v: header.begins[v.name]):
        begin, n = header.begins[v.name], header.schema.var_bytes(v)
        rows.append({"name": v.name, "record": header.schema.is_record(v.name), "begin": begin, "end": begin + n, "size": n, "gap": begin - end})
        end = begin + n
    return rows


def attribute_room(schema: Schema) -> int:
    """Bytes of all attribute values."""
    return sum(attr_bytes(a) for held in [schema.attrs, *[v.attrs for v in schema.vars]] for a in held.values())


def validation(spark: SparkSession, path: str) -> DataFrame:
    """:func:`validate_file` as a table (code, detail); no row means a valid file."""
    return spark.createDataFrame(validate_file(path), "code string, detail string")


def offsets(spark: SparkSession, path: str, numrecs: int = 1) -> DataFrame:
    """:func:`offsets_report` as a table, with a row for each of the first ``numrecs`` records of a record variable."""
    recsize = _recsize(read_header(path).schema)
    rows = []
    for r in offsets_report(path):
        for k in range(numrecs if r["record"] else 1):
            rows.append((r["name"], r["record"], k, r["begin"] + k * recsize, r["end"] + k * recsize, r["size"], r["gap"]))
    return spark.createDataFrame(rows, "name string, is_record boolean, record long, begin long, end long, size long, gap long")


def file_format(path: str) -> int:
    """The version of a file, from its first bytes alone."""
    fs, at = _fs(path)
    if fs.get_file_info(at).type != pafs.FileType.File:
        raise ArrayError("NC_ENOENT", path)
    with fs.open_input_file(at) as f:
        magic = f.read_at(4, 0)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ArrayError("NC_ENOTNC", path)
    return magic[3]


def file_info(path: str, **hints) -> dict[str, str]:
    """What is known of a file and how it is read: sizes, places, and the hints in effect.

    Striping is the file system's own matter here: one file, in ranges of ``partition_bytes``.
    """
    header, (fs, at) = read_header(path), _fs(path)
    begins = header.begins.values()
    known = {
        "path": path, "file_size": fs.get_file_info(at).size, "format": header.schema.version, "header_size": header.size, "header_extent": min(begins, default=header.size),
        "record_size": _recsize(header.schema), "numrecs": header.schema.numrecs, "striping_factor": 1, "striping_unit": hints.get("partition_bytes", 64 << 20),
        "partition_bytes": 64 << 20, "header_chunk": CHUNK, "h_align": 4, "v_align": 4, "r_align": 4,
    }
    return {k: str(v) for k, v in (known | hints).items()}
