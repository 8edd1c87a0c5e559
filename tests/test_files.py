import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fill as L
from gridloom.operators.diff import diff_schema, diff_values
from gridloom.functions.types import TYPES
from gridloom.plans.catalog import Dataset, Schema, catalog_frames, consistency, default_format, lib_version, set_default_format
from gridloom.plans.errors import ArrayError
from gridloom.sources import cdf, cdl


def small(version=5):
    s = Schema(version)
    for name, n in (("t", 0), ("y", 2), ("x", 3)):
        s.def_dim(name, n)
    s.def_var("a", "short", ["y", "x"])
    s.def_var("r", "double", ["t", "x"])
    s.def_var("q", "byte", ["t"])
    s.def_var("z", "int", [])
    s.def_var("name", "char", ["y", "x"])
    s.put_att("a", "units", "char", "m/s")
    s.put_att(None, "levels", "int", [1, 2, 3])
    return s


def data(spark):
    return {
        "a": L.grid(spark, [2, 3]).withColumn("value", (F.col("d0") * 3 + F.col("d1") - 4).cast("short")),
        "r": L.grid(spark, [4, 3]).withColumn("value", F.col("d0") / 2 + F.col("d1")),
        "q": L.grid(spark, [4]).withColumn("value", F.col("d0").cast("byte")),
        "z": spark.createDataFrame([(42,)], "value int"),
        "name": L.grid(spark, [2, 3]).withColumn("value", F.chr(F.lit(97) + F.col("d0") * 3 + F.col("d1"))),
    }


@pytest.mark.parametrize("version", [1, 2, 5])
def test_round_trip(spark, tmp_path, version):
    path = str(tmp_path / "a.nc")
    s = small(version)
    cdf.write_dataset(Dataset(s, data(spark)), path)
    back = cdf.open_dataset(spark, path, partition_bytes=32)
    assert back.schema.numrecs == 4 and back.schema.version == version
    for name, v in data(spark).items():
        assert diff_values(v, back.var(name), len(s.var(name).dims)).count() == 0, name
    assert not diff_schema(s, back.schema) and not cdf.validate_file(path)
    assert [r["gap"] for r in cdf.offsets_report(path)] == [0] * 5
    part = spark.read.format("cdf").options(variable="r", **{"from": "1", "to": "3"}).load(path)
    assert sorted({r.d0 for r in part.collect()}) == [1, 2]
    with pytest.raises(ArrayError, match="NC_EEXIST"):
        cdf.write_dataset(Dataset(small(version), data(spark)), path, clobber=False)
    cdf.delete(path)
    with pytest.raises(ArrayError, match="NC_ENOENT"):
        cdf.open_dataset(spark, path)


def test_hand_made_header(spark, tmp_path):
    """A version 1 file with one variable of three shorts, written byte by byte."""
    name = lambda s: struct.pack(">I", len(s)) + s + b"\0" * (-len(s) % 4)
    head = b"CDF\1" + struct.pack(">I", 0) + struct.pack(">II", 10, 1) + name(b"x") + struct.pack(">I", 3) + struct.pack(">II", 0, 0)
    head += struct.pack(">II", 11, 1) + name(b"v") + struct.pack(">II", 1, 0) + struct.pack(">II", 0, 0) + struct.pack(">II", 3, 8)
    head += struct.pack(">I", len(head) + 4)
    path = tmp_path / "h.nc"
    path.write_bytes(head + np.array([5, -6, 7], ">i2").tobytes() + b"\0\0")
    d = cdf.open_dataset(spark, str(path))
    assert [r.value for r in d.var("v").orderBy("d0").collect()] == [5, -6, 7]
    assert cdf.encode_header(d.schema, {"v": len(head)}) == head


def test_single_record_variable_is_not_padded(spark, tmp_path):
    s = Schema(2)
    s.def_dim("t", 0)
    s.def_var("b", "byte", ["t"])
    path = str(tmp_path / "one.nc")
    cdf.write_dataset(Dataset(s, {"b": L.grid(spark, [5]).withColumn("value", F.col("d0").cast("byte"))}), path)
    assert s.layout()[1] == 1
    assert [r.value for r in cdf.open_dataset(spark, path).var("b").orderBy("d0").collect()] == [0, 1, 2, 3, 4]


def test_fill_is_written(spark, tmp_path):
    s = Schema(5)
    s.def_dim("x", 4)
    s.def_var("u", "uint64", ["x"])
    s.def_var_fill("u", False)
    path = str(tmp_path / "f.nc")
    cdf.write_dataset(Dataset(s, {"u": spark.createDataFrame([(1,)], "d0 long").selectExpr("d0", "cast('18446744073709551615' as decimal(20,0)) as value")}), path)
    assert [int(r.value) for r in cdf.open_dataset(spark, path).var("u").orderBy("d0").collect()] == [2**64 - 2, 2**64 - 1, 2**64 - 2, 2**64 - 2]


def test_broken_files(tmp_path):
    path = tmp_path / "b.nc"
    path.write_bytes(b"HDF\1")
    assert cdf.validate_file(str(path))[0][0] == "NC_ENOTNC"
    path.write_bytes(cdf.encode_header(small())[:-9])
    assert cdf.validate_file(str(path))[0][0] == "NC_ENOTNC"
    path.write_bytes(cdf.encode_header(small()))  # all variables begin at 0
    assert cdf.validate_file(str(path))


def test_text_form(spark):
    d = Dataset(small(), data(spark))
    d.schema.enddef()
    d.sync_numrecs()
    text = cdl.dump(d, "small")
    assert "\tt = UNLIMITED ; // (4 currently)" in text and '\t\ta:units = "m/s" ;' in text and "\t\t:levels = 1, 2, 3 ;" in text
    assert ' name =\n  "abc",\n  "def" ;' in text
    back = cdl.load(spark, text)
    assert not diff_schema(d.schema, back.schema)
    for name, v in data(spark).items():
        assert diff_values(v, back.var(name), len(d.schema.var(name).dims)).count() == 0, name
    assert "data:" not in cdl.dump(d, "small", header_only=True)
    assert "// a(2,1)" in cdl.dump(d, "small", annotate=True, language="f", variables=["a"])
    with pytest.raises(cdl.CdlError):
        cdl.parse("netcdf x { variables: complex v ; }")


def test_definition_errors():
    s = Schema(1)
    s.def_dim("t", 0)
    s.def_dim("x", 3)
    for call, error in (
        (lambda: s.def_dim("u", 0), "NC_EUNLIMIT"), (lambda: s.def_dim("x", 2), "NC_ENAMEINUSE"), (lambda: s.def_dim("big", 2**31), "NC_EDIMSIZE"), (lambda: s.def_dim("a/b", 1), "NC_EBADNAME"),
        (lambda: s.def_var("v", "uint64", ["x"]), "NC_ESTRICTCDF2"), (lambda: s.def_var("v", "int", ["x", "t"]), "NC_EUNLIMPOS"), (lambda: s.def_var("v", "int", ["nope"]), "NC_EBADDIM"),
        (lambda: s.var("nope"), "NC_ENOTVAR"), (lambda: s.get_att(None, "nope"), "NC_ENOTATT"), (lambda: s.redef(), "NC_EINDEFINE"),
    ):
        with pytest.raises(ArrayError, match=error):
            call()
    s.def_var("v", "int", ["t", "x"])
    for values, kind, error in (([1, 2], "int", "NC_EINVAL"), ([1], "short", "NC_EBADTYPE")):
        with pytest.raises(ArrayError, match=error):
            s.put_att("v", "_FillValue", kind, values)
    s.put_att("v", "_FillValue", "int", [9])
    assert s.inq_var_fill("v") == (False, 9)
    s.put_att("v", "note", "char", "abcdefgh")
    s.enddef()
    s.put_att("v", "note", "char", "abc")
    with pytest.raises(ArrayError, match="NC_ENOTINDEFINE"):
        s.put_att("v", "note", "char", "a longer text than before")
    with pytest.raises(ArrayError, match="NC_ENOTINDEFINE"):
        s.def_dim("y", 1)
    new = s.evolve()
    new.def_dim("y", 1)
    new.rename_var("v", "w")
    assert s.inquire()["ndims"] == 2 and new.inquire()["ndims"] == 3 and s.vars[0].name == "v"
    other = Schema(5)
    s.copy_att("v", "note", other, None)
    assert other.get_att(None, "note") == "abc"
    other.del_att(None, "note")
    assert other.inquire()["ngatts"] == 0


def test_consistency(spark):
    a, b = small(), small()
    b.dims[1].size = 5
    b.put_att("a", "units", "char", "km")
    found = {(r.kind, r.name, r.code) for r in consistency(catalog_frames(spark, a), catalog_frames(spark, b)).collect()}
    assert found == {("dim", "y", "NC_EMULTIDEFINE_DIM_SIZE"), ("attr", "units", "NC_EMULTIDEFINE_ATTR_VAL")}
    assert consistency(catalog_frames(spark, a), catalog_frames(spark, small())).count() == 0


def test_boxes_decide_what_is_read(spark, tmp_path):
    path = str(tmp_path / "f.nc")
    s = Schema(5)
    s.def_dim("y", 1000)
    s.def_dim("x", 10)
    s.def_var("v", "int", ["y", "x"])
    v = L.grid(spark, [1000, 10]).withColumn("value", (F.col("d0") * 10 + F.col("d1")).cast("int"))
    cdf.write_dataset(Dataset(s, {"v": v}), path)
    frame = cdf.open_dataset(spark, path, partition_bytes=400).var("v")
    part = cdf.box(spark, path, "v", [10, 3], [4, 1], [2, 1], partition_bytes=400)
    assert sorted(map(tuple, part.collect())) == [(k, 0, (10 + 2 * k) * 10 + 3) for k in range(4)]
    assert part.rdd.getNumPartitions() == 1 and frame.rdd.getNumPartitions() == 100 and cdf.box(spark, path, "v", [5, 0], [0, 10]).count() == 0
    assert frame.filter("d0 = 7").count() == 10 and frame.count() == 10_000  # one query leaves no trace in the next
    with pytest.raises(ArrayError, match="NC_EEDGE"):
        cdf.box(spark, path, "v", [990, 0], [11, 1])


@pytest.mark.parametrize("kind", ["byte", "char", "short", "int", "float", "double", "ubyte", "ushort", "uint", "int64", "uint64"])
def test_tables_are_written_as_files(spark, tmp_path, kind):
    spark.dataSource.register(cdf.CdfSource)
    path = str(tmp_path / "w.nc")
    value = F.chr(F.lit(97) + F.col("d1")) if kind == "char" else F.col("d0") * 10 + F.col("d1")
    v = L.grid(spark, [12, 7]).withColumn("value", value.cast(TYPES[kind].spark)).filter("d0 <> 5")
    how = {"variable": "v", "type": kind, "shape": "0,7", "records": "12"}
    v.repartition(3).write.format("cdf").options(**how).mode("append").save(path)
    back = cdf.open_dataset(spark, path).var("v")
    assert diff_values(v, back.filter("d0 <> 5"), 2).count() == 0 and back.count() == 84
    v.limit(0).write.format("cdf").options(**how).mode("overwrite").save(path)
    assert cdf.open_dataset(spark, path).var("v").filter("d0 = 3").select("value").distinct().count() == 1
    assert [f.name for f in tmp_path.iterdir()] == ["w.nc"]


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "a.nc")
    cdf.write_dataset(Dataset(small(), data(spark)), path)
    before = open(path, "rb").read()
    broken = data(spark) | {"r": spark.range(3).selectExpr("id AS d0", "id AS d1", "raise_error('broken') AS value")}
    with pytest.raises(Exception, match="broken"):
        cdf.write_dataset(Dataset(small(), broken), path)
    assert open(path, "rb").read() == before and [f.name for f in tmp_path.iterdir()] == ["a.nc"]


def test_what_files_tell(spark, tmp_path):
    path = str(tmp_path / "a.nc")
    s = small(2)
    cdf.write_dataset(Dataset(s, data(spark)), path, h_align=512)
    assert cdf.file_format(path) == 2
    info = cdf.file_info(path, partition_bytes=1 << 20)
    assert info["header_extent"] == "512" and int(info["header_size"]) == s.header_size() < 512 and info["striping_unit"] == str(1 << 20) and info["numrecs"] == "4"
    assert s.header_extent(h_align=512) == 512 and s.num_rec_vars() == 2 and s.num_fix_vars() == 3 and s.record_size() == 28 and s.var_offset("a") == s.header_size()
    assert cdf.validation(spark, path).count() == 0
    table = cdf.offsets(spark, path, numrecs=4)
    assert table.filter("name = 'r'").count() == 4 and {r.begin for r in table.filter("name = 'q'").collect()} == {512 + 12 + 4 + 8 + 24 + 28 * k for k in range(4)}
    open(path, "r+b").write(b"XDF")
    assert [r.code for r in cdf.validation(spark, path).collect()] == ["NC_ENOTNC"]
    with pytest.raises(ArrayError, match="NC_ENOTNC"):
        cdf.file_format(path)


def test_default_format():
    was = set_default_format(2)
    try:
        assert was == 5 and Schema().version == 2 and default_format() == 2 and lib_version()
        with pytest.raises(ArrayError, match="NC_EINVAL"):
            set_default_format(3)
    finally:
        set_default_format(was)
    assert Schema().version == 5


def test_large_integer_attributes_differ(spark):
    def one(n):
        s = Schema()
        s.put_att(None, "n", "int64", [n])
        return catalog_frames(spark, s)

    assert [r.code for r in consistency(one(2**60), one(2**60 + 1)).collect()] == ["NC_EMULTIDEFINE_ATTR_VAL"] and consistency(one(2**60), one(2**60)).count() == 0
