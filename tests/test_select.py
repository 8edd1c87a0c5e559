import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fill as L
from gridloom.operators import select as S
from gridloom.plans.errors import ArrayError
from gridloom.queries import QUERIES

SHAPE = (6, 7)


@pytest.fixture(scope="module")
def cube():
    return np.arange(42).reshape(SHAPE)


@pytest.fixture(scope="module")
def v(spark):
    return L.grid(spark, SHAPE).withColumn("value", F.col("d0") * 7 + F.col("d1")).cache()


def as_array(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r.d0, r.d1] = r.value
    return out


def test_elements_and_boxes(v, cube):
    assert S.var1(v, [2, 3], SHAPE).collect()[0].value == cube[2, 3]
    assert (as_array(S.vara(v, [1, 2], [3, 4], SHAPE), (3, 4)) == cube[1:4, 2:6]).all()
    assert (as_array(S.vars_(v, [0, 1], [3, 3], [2, 2], SHAPE), (3, 3)) == cube[0:5:2, 1:6:2]).all()
    assert S.vara(v, [1, 2], [0, 4], SHAPE).count() == 0
    assert (as_array(S.without_halo(v, SHAPE, 2), (2, 3)) == cube[2:4, 2:5]).all()
    assert (as_array(S.transposed(v, [1, 0]), (7, 6)) == cube.T).all()


def test_index_map(v, cube):
    rows = S.varm(v, [0, 0], [6, 7], None, [1, 6], SHAPE).collect()
    buffer = np.empty(42, int)
    for r in rows:
        buffer[r.m] = r.value
    assert (buffer == cube.T.ravel()).all()


def test_lists_of_boxes(v, cube):
    starts, counts = [[0, 0], [0, 1], [5, 6], [3, 3]], [[2, 3], [2, 3], None, [0, 2]]
    rows = sorted((r.seq, r.place, r.value) for r in S.varn(v, starts, counts, SHAPE).collect())
    want = [(j, k, x) for j, (s, c) in enumerate(zip(starts, counts, strict=True)) for k, x in enumerate(cube[s[0] : s[0] + (c or [1, 1])[0], s[1] : s[1] + (c or [1, 1])[1]].ravel())]
    assert rows == want


def test_lists_of_boxes_against_brute_force(v):
    starts, counts = [[0, 0], [0, 1], [5, 6], [3, 3], [1, 1]], [[2, 3], [4, 3], None, [0, 2], [5, 5]]
    cells = {(r.d0, r.d1): r.value for r in v.collect()}
    want = sorted(
        (k, i, j, i * (c or [1, 1])[1] + j, cells[s[0] + i, s[1] + j])
        for k, (s, c) in enumerate(zip(starts, counts, strict=True)) for i in range((c or [1, 1])[0]) for j in range((c or [1, 1])[1]) if (s[0] + i, s[1] + j) in cells
    )
    found = S.varn(v, starts, counts)
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_lists_of_columns(v):
    shape = (40, 300)
    wide = L.grid(v.sparkSession, shape).withColumn("value", F.col("d0") * 1000 + F.col("d1"))
    starts, counts = [[0, j] for j in range(300)] + [[3, 0], [9, 9]], [[40, 1]] * 300 + [[1, 300], [0, 5]]
    assert S._cells(counts, shape) == {1: 3}  # columns are told apart by the second axis alone, of mean length 605 / 302
    found = S.varn(wide, starts, counts, shape)
    got = sorted((r.seq, r.place, r.value) for r in found.collect())
    want = [(j, i, i * 1000 + j) for j in range(300) for i in range(40)] + [(300, j, 3000 + j) for j in range(300)]
    assert got == want


def test_cells_of_tiles():
    assert S._cells([[2, 3], [4, 3]], [100, 90]) == {0: 3, 1: 3}
    assert S._cells([[100, 90]], [100, 90]) == {0: 100}  # one that is the whole hull
    assert S._cells([[0]], [0]) == {0: 1}


def test_writes(v, cube):
    new = L.grid(v.sparkSession, [2, 2], [1, 1]).withColumns({"value": F.lit(-5).cast("long"), "seq": F.lit(1)})
    again = L.grid(v.sparkSession, [1, 1], [1, 1]).withColumns({"value": F.lit(-6).cast("long"), "seq": F.lit(2)})
    want = cube.copy()
    want[1:3, 1:3] = -5
    want[1, 1] = -6
    assert (as_array(S.put(v, new.unionByName(again), 2), SHAPE) == want).all()
    want[1, 1] = -5
    assert (as_array(S.put(v, new.unionByName(again), 2, "first"), SHAPE) == want).all()
    with pytest.raises(ArrayError):
        S.put(v, new.unionByName(again), 2, "error").collect()


@pytest.mark.parametrize(
    ("start", "count", "stride", "options", "error"),
    [
        ([-1, 0], [1, 1], None, {}, "NC_EINVALCOORDS"),
        ([6, 0], [0, 1], None, {}, "NC_EINVALCOORDS"),
        ([0, 0], [-1, 1], None, {}, "NC_ENEGATIVECNT"),
        ([0, 0], [7, 1], None, {}, "NC_EEDGE"),
        ([4, 0], [3, 1], None, {}, "NC_EEDGE"),
        ([0, 0], [3, 1], [3, 1], {}, "NC_EEDGE"),
        ([0, 0], [1, 1], [0, 1], {}, "NC_ESTRIDE"),
        ([2, 0], [0, 1], None, {"record": True, "numrecs": 2}, "NC_EINVALCOORDS"),
        ([1, 0], [2, 1], None, {"record": True, "numrecs": 2}, "NC_EEDGE"),
        ([2**32, 0], [1, 1], None, {"record": True, "writing": True, "version": 2}, "NC_EINVALCOORDS"),
        ([9, 0], [5, 1], None, {"record": True, "numrecs": 2, "writing": True}, None),
        ([0, 0], [2, 7], None, {}, None),
    ],
)
def test_checks(start, count, stride, options, error):
    if error is None:
        S.validate(SHAPE, start, count, stride, **options)
        return
    with pytest.raises(ArrayError) as e:
        S.validate(SHAPE, start, count, stride, **options)
    assert e.value.name == error


def test_contiguous():
    assert S.contiguous([4, 5], [1, 0], [2, 5])
    assert not S.contiguous([4, 5], [1, 0], [2, 4])
    assert S.contiguous([4, 5], [1, 2], [1, 3])


def test_predicates_reach_the_scan(spark, tmp_path, v):
    v.write.parquet(str(tmp_path / "v"))
    plan = S.vara(spark.read.parquet(str(tmp_path / "v")), [1, 2], [3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d0,1)" in plan


def orders(spark, tmp_path, n=1530):
    """A folder with a table of orders: a grid of 100 columns whose last row is not full."""
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 1.5).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_put_returns_the_whole_grid(spark, tmp_path):
    want = {(k // 100, k % 100): k * 1.5 for k in range(1530)}
    want |= {(i, j): -2.0 for i in (0, 1) for j in range(5, 20)}
    want |= {(i, j): -1.0 for i in (1, 2) for j in range(10)}
    got = QUERIES["put_boxes"](spark, orders(spark, tmp_path)).collect()
    assert len(got) == len(want) and {(r.d0, r.d1): r.value for r in got} == want


def test_index_map_of_the_whole_buffer(spark, tmp_path):
    spark.range(530).selectExpr("id AS vec_id", "transform(sequence(0, 63), k -> CAST(id * 64 + k AS FLOAT)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["sel_varm_transpose"](spark, str(tmp_path)).select("m", "d0", "d1", "value").collect()))
    assert got == [(m, m % 530, m // 530, float(m % 530 * 64 + m // 530)) for m in range(530 * 64)]


def test_places_run_to_the_end_of_the_grid(spark, tmp_path):
    got = QUERIES["sel_vard"](spark, orders(spark, tmp_path)).collect()
    assert sorted((r.place, r.d0, r.d1, r.value) for r in got) == [(k, k // 100, k % 100, k * 1.5) for k in range(0, 1530, 7)]
