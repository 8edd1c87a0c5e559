"""Schemas of array datasets: dimensions, variables and attributes, defined in one mode and frozen in another.

A schema is plain Python on the driver, for it is small by the format's limits; :func:`catalog_frames` gives it as tables. A
:class:`Dataset` joins a schema to one long-form DataFrame for each variable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.types import FORMATS, TYPES, valid_for
from gridloom.operators.fill import fill_value
from gridloom.plans.errors import ArrayError

#: What :func:`lib_version` tells.
VERSION = "gridloom 0.2"
_default_format = 5


def lib_version() -> str:
    return VERSION


def set_default_format(version: int) -> int:
    """The format of schemas that name none from now on; returns what it was."""
    global _default_format
    if version not in FORMATS:
        raise ArrayError("NC_EINVAL", str(version))
    was, _default_format = _default_format, version
    return was


def default_format() -> int:
    return _default_format


MAX_DIMS, MAX_VARS, MAX_ATTRS, MAX_NAME = 1024, 8192, 8192, 256
UNLIMITED = 0
#: In attribute calls, the dataset itself.
GLOBAL = None


def checked_name(name: str) -> str:
    """A name in normal form C; raises if the format does not allow it."""
    name = unicodedata.normalize("NFC", name)
    first = re.match(r"[A-Za-z0-9_]|[^\x00-\x7f]", name)
    if not name or len(name.encode()) > MAX_NAME or not first or re.search(r"[\x00-\x1f/\x7f]", name) or name != name.rstrip(" "):
        raise ArrayError("NC_EBADNAME", repr(name))
    return name


@dataclass
class Dim:
    name: str
    size: int
    unlimited: bool = False


Attr = tuple[str, tuple]  # type and values; text as one string in a tuple


@dataclass
class Var:
    name: str
    kind: str
    dims: list[int]
    attrs: dict[str, Attr] = field(default_factory=dict)
    no_fill: bool = True
    fill: object = None


@dataclass
class Schema:
    """Dimensions, variables and attributes of a dataset, and the mode it is in."""

    version: int = field(default_factory=lambda: _default_format)
    dims: list[Dim] = field(default_factory=list)
    vars: list[Var] = field(default_factory=list)
    attrs: dict[str, Attr] = field(default_factory=dict)
    defining: bool = True
    numrecs: int = 0
    fill_mode: bool = False

    def __post_init__(self) -> None:
        if self.version not in FORMATS:
            raise ArrayError("NC_ENOTNC", str(self.version))

    # definition

    def _define(self) -> None:
        if not self.defining:
            raise ArrayError("NC_ENOTINDEFINE")

    def def_dim(self, name: str, size: int) -> int:
        self._define()
        name = checked_name(name)
        most = {1: 2**31 - 4, 2: 2**32 - 4, 5: 2**63 - 4}[self.version]
        if not 0 <= size <= most:
            raise ArrayError("NC_EDIMSIZE", name)
        if size == UNLIMITED and any(d.unlimited for d in self.dims):
            raise ArrayError("NC_EUNLIMIT", name)
        if any(d.name == name for d in self.dims):
            raise ArrayError("NC_ENAMEINUSE", name)
        if len(self.dims) >= MAX_DIMS:
            raise ArrayError("NC_EINVAL", "too many dimensions")
        self.dims.append(Dim(name, size, size == UNLIMITED))
        return len(self.dims) - 1

    def def_var(self, name: str, kind: str, dims: Sequence[int | str]) -> int:
        self._define()
        name = checked_name(name)
        if kind not in TYPES:
            raise ArrayError("NC_EBADTYPE", kind)
        if not valid_for(kind, self.version):
            raise ArrayError("NC_ESTRICTCDF2", kind)
        ids = [self.dimid(d) if isinstance(d, str) else d for d in dims]
        for i, d in enumerate(ids):
            if not 0 <= d < len(self.dims):
                raise ArrayError("NC_EBADDIM", str(d))
            if self.dims[d].unlimited and i:
                raise ArrayError("NC_EUNLIMPOS", name)
        if any(v.name == name for v in self.vars):
            raise ArrayError("NC_ENAMEINUSE", name)
        if len(self.vars) >= MAX_VARS:
            raise ArrayError("NC_EINVAL", "too many variables")
        self.vars.append(Var(name, kind, ids, no_fill=not self.fill_mode))
        return len(self.vars) - 1

    def enddef(self) -> Schema:
        if not self.defining:
            raise ArrayError("NC_ENOTINDEFINE")
        if self.version < 5:
            most = 2**31 - 4 if self.version == 1 else 2**32 - 4
            large = [v for v in self.vars if self.var_bytes(v) > most]
            if len(large) > 1 or large and large[0] is not self.vars[-1]:
                raise ArrayError("NC_EVARSIZE", large[0].name)
        self.defining = False
        return self

    def redef(self) -> Schema:
        if self.defining:
            raise ArrayError("NC_EINDEFINE")
        self.defining = True
        return self

    def evolve(self) -> Schema:
        """A copy in define mode; this one stays as it is."""
        return replace(
            self, dims=[replace(d) for d in self.dims], vars=[replace(v, dims=list(v.dims), attrs=dict(v.attrs)) for v in self.vars], attrs=dict(self.attrs), defining=True
        )

    # inquiry

    def dimid(self, name: str) -> int:
        name = unicodedata.normalize("NFC", name)
        for i, d in enumerate(self.dims):
            if d.name == name:
                return i
        raise ArrayError("NC_EBADDIM", name)

    def varid(self, name: str) -> int:
        name = unicodedata.normalize("NFC", name)
        for i, v in enumerate(self.vars):
            if v.name == name:
                return i
        raise ArrayError("NC_ENOTVAR", name)

    def var(self, name: str | int) -> Var:
        if isinstance(name, str):
            return self.vars[self.varid(name)]
        if not 0 <= name < len(self.vars):
            raise ArrayError("NC_ENOTVAR", str(name))
        return self.vars[name]

    def dim_length(self, dim: int | str) -> int:
        d = self.dims[self.dimid(dim) if isinstance(dim, str) else dim]
        return self.numrecs if d.unlimited else d.size

    def is_record(self, name: str | int) -> bool:
        v = self.var(name)
        return bool(v.dims) and self.dims[v.dims[0]].unlimited

    def shape(self, name: str | int) -> list[int]:
        """Lengths of a variable's axes, records as they are now."""
        return [self.dim_length(d) for d in self.var(name).dims]

    @property
    def unlimited(self) -> int:
        return next((i for i, d in enumerate(self.dims) if d.unlimited), -1)

    def inquire(self) -> dict[str, int]:
        """Counts of what the dataset has."""
        records = sum(self.is_record(i) for i in range(len(self.vars)))
        return {
            "ndims": len(self.dims), "nvars": len(self.vars), "ngatts": len(self.attrs), "unlimdimid": self.unlimited,
            "num_rec_vars": records, "num_fix_vars": len(self.vars) - records, "version": self.version,
        }

    def num_rec_vars(self) -> int:
        return self.inquire()["num_rec_vars"]

    def num_fix_vars(self) -> int:
        return self.inquire()["num_fix_vars"]

    def header_size(self) -> int:
        """Bytes of the header."""
        from gridloom.sources.cdf import header_size

        return header_size(self)

    def header_extent(self, **align: int) -> int:
        """Bytes before the first variable."""
        return min(self.layout(**align)[0].values(), default=self.header_size())

    def record_size(self) -> int:
        return self.layout()[1]

    def var_offset(self, name: str | int) -> int:
        return self.layout()[0][self.var(name).name]

    def inquire_var(self, name: str | int) -> dict:
        v = self.var(name)
        return {"name": v.name, "type": v.kind, "ndims": len(v.dims), "dimids": list(v.dims), "natts": len(v.attrs)}

    # renaming and attributes

    def rename_dim(self, old: str, new: str) -> None:
        self._rename(self.dims, self.dims[self.dimid(old)], new)

    def rename_var(self, old: str, new: str) -> None:
        self._rename(self.vars, self.var(old), new)

    def _rename(self, among: list, thing, new: str) -> None:
        new = checked_name(new)
        if any(x.name == new for x in among):
            raise ArrayError("NC_ENAMEINUSE", new)
        if not self.defining and len(new.encode()) > len(thing.name.encode()):
            raise ArrayError("NC_ENOTINDEFINE", "a longer name needs define mode")
        thing.name = new

    def _attrs(self, var: str | int | None) -> dict[str, Attr]:
        return self.attrs if var is GLOBAL else self.var(var).attrs

    def put_att(self, var: str | int | None, name: str, kind: str, values: Sequence | str) -> None:
        """Sets an attribute; outside define mode only one that takes no more room. A fill attribute turns filling on."""
        name, attrs = checked_name(name), self._attrs(var)
        if not valid_for(kind, self.version):
            raise ArrayError("NC_ESTRICTCDF2" if kind in TYPES else "NC_EBADTYPE", kind)
        if (kind == "char") != isinstance(values, str):
            raise ArrayError("NC_ECHAR", name)
        held = (values,) if isinstance(values, str) else tuple(values)
        if name == "_FillValue" and var is not GLOBAL:
            if kind != self.var(var).kind:
                raise ArrayError("NC_EBADTYPE", name)
            if len(held) != 1:
                raise ArrayError("NC_EINVAL", name)
            self.var(var).no_fill = False
        t = TYPES[kind]
        if kind != "char" and t.low is not None and any(not t.low <= x <= t.high for x in held):
            raise ArrayError("NC_ERANGE", name)
        if not self.defining and (name not in attrs or attr_bytes((kind, held)) > attr_bytes(attrs[name])):
            raise ArrayError("NC_ENOTINDEFINE", name)
        if name not in attrs and len(attrs) >= MAX_ATTRS:
            raise ArrayError("NC_EINVAL", "too many attributes")
        attrs[name] = (kind, held)

    def get_att(self, var: str | int | None, name: str, kind: str | None = None):
        """The values of an attribute, as text or a tuple, converted to ``kind``; an element out of its range is an error."""
        found = self._attrs(var).get(unicodedata.normalize("NFC", name))
        if found is None:
            raise ArrayError("NC_ENOTATT", name)
        held, values = found
        if kind and (kind == "char") != (held == "char"):
            raise ArrayError("NC_ECHAR", name)
        if held == "char":
            return values[0]
        if kind and TYPES[kind].low is not None and any(not TYPES[kind].low <= x <= TYPES[kind].high for x in values):
            raise ArrayError("NC_ERANGE", name)
        return tuple(int(x) if kind and kind not in ("float", "double") else x for x in values)

    def inquire_att(self, var: str | int | None, name: str) -> dict:
        attrs = self._attrs(var)
        if name not in attrs:
            raise ArrayError("NC_ENOTATT", name)
        kind, values = attrs[name]
        return {"name": name, "type": kind, "len": len(values[0].encode()) if kind == "char" else len(values), "attnum": list(attrs).index(name)}

    def att_name(self, var: str | int | None, number: int) -> str:
        names = list(self._attrs(var))
        if not 0 <= number < len(names):
            raise ArrayError("NC_ENOTATT", str(number))
        return names[number]

    def rename_att(self, var: str | int | None, old: str, new: str) -> None:
        attrs, new = self._attrs(var), checked_name(new)
        if old not in attrs:
            raise ArrayError("NC_ENOTATT", old)
        if new in attrs:
            raise ArrayError("NC_ENAMEINUSE", new)
        if not self.defining and len(new.encode()) > len(old.encode()):
            raise ArrayError("NC_ENOTINDEFINE", "a longer name needs define mode")
        items = [(new if k == old else k, v) for k, v in attrs.items()]
        attrs.clear()
        attrs.update(items)

    def del_att(self, var: str | int | None, name: str) -> None:
        self._define()
        if self._attrs(var).pop(name, None) is None:
            raise ArrayError("NC_ENOTATT", name)

    def copy_att(self, var: str | int | None, name: str, to: Schema, to_var: str | int | None) -> None:
        kind, values = self._attrs(var).get(name) or (None, None)
        if kind is None:
            raise ArrayError("NC_ENOTATT", name)
        to.put_att(to_var, name, kind, values[0] if kind == "char" else values)

    # fill

    def set_fill(self, on: bool) -> bool:
        """Turns filling on or off for all variables, and those to come; returns what it was."""
        self._define()
        was, self.fill_mode = self.fill_mode, on
        for v in self.vars:
            v.no_fill = not on
        return was

    def def_var_fill(self, name: str | int, no_fill: bool, value=None) -> None:
        self._define()
        v = self.var(name)
        v.no_fill = no_fill
        if value is not None and not no_fill:
            self.put_att(name, "_FillValue", v.kind, [value] if v.kind != "char" else value)

    def inq_var_fill(self, name: str | int) -> tuple[bool, object]:
        v = self.var(name)
        return v.no_fill, fill_value(v.kind, v.attrs.get("_FillValue"))

    # layout

    def var_bytes(self, v: Var) -> int:
        """Bytes of a variable, or of one record of it, padded to 4."""
        lengths = [self.dims[d].size for d in v.dims if not self.dims[d].unlimited]
        return -(-prod(lengths) * TYPES[v.kind].size // 4) * 4

    def layout(self, h_align: int = 4, v_align: int = 4, r_align: int = 4) -> tuple[dict[str, int], int]:
        """Where each variable begins, fixed ones before records, and the bytes of a record."""
        from gridloom.sources.cdf import header_size

        at = -(-header_size(self) // h_align) * h_align
        begins: dict[str, int] = {}
        for v in (v for i, v in enumerate(self.vars) if not self.is_record(i)):
            at = -(-at // v_align) * v_align
            begins[v.name] = at
            at += self.var_bytes(v)
        at = -(-at // r_align) * r_align
        records = [v for i, v in enumerate(self.vars) if self.is_record(i)]
        for v in records:
            begins[v.name] = at
            at += self.var_bytes(v)
        if len(records) == 1:  # a single record variable is not padded
            v = records[0]
            return begins, prod(self.dims[d].size for d in v.dims[1:]) * TYPES[v.kind].size
        return begins, sum(map(self.var_bytes, records))


def attr_bytes(attr: Attr) -> int:
    kind, values = attr
    n = len(values[0].encode()) if kind == "char" else len(values) * TYPES[kind].size
    return -(-n // 4) * 4


@dataclass
class Dataset:
    """A schema with the data of its variables."""

    schema: Schema
    data: dict[str, DataFrame]

    def var(self, name: str) -> DataFrame:
        self.schema.varid(name)
        return self.data[name]

    def sync_numrecs(self) -> int:
        """The number of records that the data hold."""
        from gridloom.operators.reduce import numrecs

        found = [df for n, df in self.data.items() if self.schema.is_record(n)]
        self.schema.numrecs = max(self.schema.numrecs, numrecs(*found).first()[0]) if found else 0
        return self.schema.numrecs


def catalog_frames(spark: SparkSession, schema: Schema) -> dict[str, DataFrame]:
    """The schema as tables: dims, vars (with layout) and attrs."""
    begins, _ = schema.layout()
    dims = [(i, d.name, schema.dim_length(i), d.unlimited) for i, d in enumerate(schema.dims)]
    rows = [
        (i, v.name, v.kind, list(v.dims), [int(n) for n in schema.shape(i)], schema.is_record(i), begins[v.name], schema.var_bytes(v), v.no_fill)
        for i, v in enumerate(schema.vars)
    ]
    attrs = [
        (varid, name, kind, values[0] if kind == "char" else None, None if kind == "char" else [float(x) for x in values], None if kind == "char" else [repr(x) for x in values])
        for varid, held in [(-1, schema.attrs), *[(i, v.attrs) for i, v in enumerate(schema.vars)]]
        for name, (kind, values) in held.items()
    ]
    return {
        "dims": spark.createDataFrame(dims, "dimid int, name string, size long, is_unlimited boolean"),
        "vars": spark.createDataFrame(rows, "varid int, name string, type string, dimids array<int>, shape array<long>, is_record boolean, begin long, vsize long, no_fill boolean"),
        "attrs": spark.createDataFrame(attrs, "varid int, name string, type string, value_text string, value_num array<double>, value_exact array<string>"),
    }


#: What differs in two catalogs of one dataset, and its code.
MISMATCHES = {"dim_size": "NC_EMULTIDEFINE_DIM_SIZE", "dim_name": "NC_EMULTIDEFINE_DIM_NAME", "var_type": "NC_EMULTIDEFINE_VAR_TYPE", "var_ndims": "NC_EMULTIDEFINE_VAR_NDIMS",
              "var_dims": "NC_EMULTIDEFINE_VAR_DIMIDS", "var_name": "NC_EMULTIDEFINE_VAR_NAME", "attr_type": "NC_EMULTIDEFINE_ATTR_TYPE", "attr_len": "NC_EMULTIDEFINE_ATTR_LEN", "attr_val": "NC_EMULTIDEFINE_ATTR_VAL"}


def consistency(root: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, code) of each mismatch of two catalogs; the root's definition is the one that counts."""
    suffix = lambda df, s, *on: df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in on])

    def paired(what: str, *on: str) -> DataFrame:
        return suffix(root[what], "a", *on).join(suffix(other[what], "b", *on), list(on), "full_outer")

    code = lambda key: F.lit(MISMATCHES[key])
    d = paired("dims", "dimid")
    dim = d.select(
        F.lit("dim").alias("kind"), F.coalesce("name_a", "name_b").alias("name"),
        F.when(F.col("name_a").isNull() | F.col("name_b").isNull(), F.lit("NC_EMULTIDEFINE_DIM_NUM"))
        .when(F.col("name_a") != F.col("name_b"), code("dim_name")).when(~F.col("size_a").eqNullSafe(F.col("size_b")), code("dim_size")).alias("code"),
    )
    v = paired("vars", "varid")
    var = v.select(
        F.lit("var").alias("kind"), F.coalesce("name_a", "name_b").alias("name"),
        F.when(F.col("name_a").isNull() | F.col("name_b").isNull(), F.lit("NC_EMULTIDEFINE_VAR_NUM"))
        .when(F.col("name_a") != F.col("name_b"), code("var_name")).when(F.col("type_a") != F.col("type_b"), code("var_type"))
        .when(F.size("dimids_a") != F.size("dimids_b"), code("var_ndims")).when(F.col("dimids_a") != F.col("dimids_b"), code("var_dims")).alias("code"),
    )
    t = paired("attrs", "varid", "name")
    attr = t.select(
        F.lit("attr").alias("kind"), "name",
        F.when(F.col("type_a").isNull() | F.col("type_b").isNull(), F.lit("NC_EMULTIDEFINE_ATTR_NUM")).when(F.col("type_a") != F.col("type_b"), code("attr_type"))
        .when(~F.size("value_num_a").eqNullSafe(F.size("value_num_b")), code("attr_len"))
        .when(~(F.col("value_exact_a").eqNullSafe(F.col("value_exact_b")) & F.col("value_text_a").eqNullSafe(F.col("value_text_b"))), code("attr_val")).alias("code"),
    )
    return dim.unionByName(var).unionByName(attr).filter(F.col("code").isNotNull())
