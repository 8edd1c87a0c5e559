import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.cast import byte_bits, cast_variable, checked_cast, request_status
from gridloom.functions.index import linear, owner_block, owner_cyclic, unravel
from gridloom.functions.types import FLOAT_MAX, TYPES
from gridloom.operators import fill as L
from gridloom.operators import reduce as R
from gridloom.operators.diff import diff_values
from gridloom.plans.errors import ERRORS, ArrayError, strerror


def cast(spark, values, kind):
    df = spark.createDataFrame([(k, float(x) if x is not None else None) for k, x in enumerate(values)], "k int, x double")
    value, flag = checked_cast(F.col("x"), kind)
    return [(r.v, r.e) for r in df.select("k", value.alias("v"), flag.alias("e")).orderBy("k").collect()]


@pytest.mark.parametrize("kind", ["byte", "short", "int", "ubyte", "ushort", "uint"])
def test_limits(spark, kind):
    low, high = TYPES[kind].low, TYPES[kind].high
    got = cast(spark, [low, high, low - 1, high + 1, 2.7, -2.7 if low < 0 else 0.3, None, math.nan], kind)
    assert got == [(low, False), (high, False), (None, True), (None, True), (2, False), (-2 if low < 0 else 0, False), (None, False), (None, True)]


def test_floats_and_wide(spark):
    assert cast(spark, [1e39, -1e39, 1.5], "float") == [(pytest.approx(FLOAT_MAX), True), (pytest.approx(-FLOAT_MAX), True), (1.5, False)]
    assert cast(spark, [2.0**63, -1, 1e30], "uint64") == [(Decimal(2**63), False), (None, True), (None, True)]
    assert cast(spark, [2.0**63, -(2.0**63), 5.9], "int64") == [(None, True), (-(2**63), False), (5, False)]
    with pytest.raises(ArrayError, match="NC_ECHAR"):
        checked_cast(F.col("x"), "char", "int")


def test_byte_reinterpreted(spark):
    df = spark.createDataFrame([(x,) for x in (-128, -1, 0, 127)], "x int")
    up = [r.u for r in df.select(byte_bits(F.col("x"), True).alias("u")).collect()]
    assert up == [128, 255, 0, 127]
    down = spark.createDataFrame([(x,) for x in up], "u int").select(byte_bits(F.col("u"), False).alias("x"))
    assert [r.x for r in down.collect()] == [-128, -1, 0, 127]


def test_status_of_a_request(spark):
    v = spark.createDataFrame([(0, 1.0), (1, 300.0)], "d0 long, value double")
    assert request_status(cast_variable(v, "ubyte")).first().erange
    assert not request_status(cast_variable(v.filter("d0 = 0"), "ubyte")).first().erange
    assert not request_status(cast_variable(v.filter("d0 = 9"), "ubyte")).first().erange


def test_index(spark):
    shape = (3, 4, 5)
    rows = spark.range(60).select("id", *[x.alias(f"d{i}") for i, x in enumerate(unravel(F.col("id"), shape))])
    rows = rows.withColumn("again", linear([F.col(f"d{i}") for i in range(3)], shape))
    for r in rows.collect():
        assert (r.d0, r.d1, r.d2) == np.unravel_index(r.id, shape) and r.again == r.id
    owners = spark.range(10).select(owner_block(F.col("id"), 10, 4).alias("b"), owner_cyclic(F.col("id"), 3, 2).alias("c")).collect()
    assert [r.b for r in owners] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r.c for r in owners] == [0, 0, 1, 1, 2, 2, 0, 0, 1, 1]


def test_fill(spark):
    v = spark.createDataFrame([(0, 1, 7), (2, 0, None)], "d0 long, d1 long, value int")
    dense = {(r.d0, r.d1): (r.value, r.is_fill) for r in L.densify(v, [3, 2], L.fill_column("int"), mark=True).collect()}
    assert len(dense) == 6 and dense[0, 1] == (7, False) and dense[2, 0] == (-2147483647, True)
    one = {(r.d0, r.d1): r.value for r in L.fill_record(v, [0, 2], 2, F.lit(-1)).collect()}
    assert one == {(0, 1): 7, (2, 0): -1, (2, 1): -1}
    with pytest.raises(ArrayError, match="NC_ENOTRECVAR"):
        L.fill_record(v, [3, 2], 0, F.lit(0), is_record=False)
    with pytest.raises(ArrayError, match="NC_ENOTFILL"):
        L.fill_record(v, [3, 2], 0, F.lit(0), fill_on=False)
    masked = L.mask_fill(L.densify(v, [3, 2], F.lit(-9)), F.lit(-9))
    assert masked.filter("value is not null").count() == 1
    assert L.fill_value("int", ("int", (3,))) == 3
    with pytest.raises(ArrayError, match="NC_EBADTYPE"):
        L.fill_value("int", ("short", (3,)))


def test_reductions(spark):
    v = spark.createDataFrame([(0, 1.5), (4, 2.5)], "d0 long, value double")
    assert R.checksum(v, "double").first().checksum == 4.0
    assert R.checksum(v, "int").first().checksum == 0.0
    assert R.numrecs(v, v.filter("d0 = 0")).first().numrecs == 5
    assert R.numrecs(v.filter("d0 > 9")).first().numrecs == 0
    w = spark.createDataFrame([(2, 3, 2), (50, 0, 1)], "s0 long, c0 long, t0 long")
    assert R.written_records(w).first().numrecs == 7
    q = spark.createDataFrame([([2, 3],), ([0, 3],), ([],)], "count array<long>")
    assert [r.bytes for r in R.request_bytes(q, "short").collect()] == [12, 0, 2]


def test_differences(spark):
    nan = float("nan")
    a = spark.createDataFrame([(0, 1.0), (1, nan), (2, None), (3, 4.0)], "d0 long, value double")
    b = spark.createDataFrame([(0, 1.0), (1, nan), (2, None), (3, 5.0), (4, 6.0)], "d0 long, value double")
    assert sorted((r.d0, r.kind) for r in diff_values(a, b, 1).collect()) == [(3, "changed"), (4, "only_b")]


def test_errors():
    assert strerror(-40) == "Index exceeds dimension bound" and ERRORS["NC_ERANGE"][0] == -60
    assert "Unknown" in strerror(12345)
    assert len({c for c, _ in ERRORS.values()}) == len(ERRORS)
