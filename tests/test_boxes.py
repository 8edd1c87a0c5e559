import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import boxes as B
from gridloom.queries import QUERIES


def frame(spark, boxes):
    return spark.createDataFrame([(k, *s, *c) for k, (s, c) in enumerate(boxes)], "id long, s0 long, s1 long, c0 long, c1 long")


def brute(reads, writes):
    out = set()
    for i, (rs, rc) in enumerate(reads):
        for j, (ws, wc) in enumerate(writes):
            lo = [max(a, b) for a, b in zip(rs, ws, strict=True)]
            hi = [min(a + c, b + d) for a, c, b, d in zip(rs, rc, ws, wc, strict=True)]
            if all(a < b for a, b in zip(lo, hi, strict=True)):
                out.add((i, j, *lo, *hi))
    return out


box = st.tuples(st.tuples(st.integers(0, 20), st.integers(0, 20)), st.tuples(st.integers(0, 9), st.integers(0, 9)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(box, min_size=1, max_size=8), st.lists(box, min_size=1, max_size=8), st.sampled_from([None, 1, 3, 50]))
def test_join_equals_brute_force(spark, reads, writes, width):
    got = [tuple(r) for r in B.box_join(frame(spark, reads), frame(spark, writes), 2, width=width).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(reads, writes)


def candidates(spark, reads, writes, ndims):
    """Pairs that meet in a cell of the grid, before the overlap is checked."""
    named = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    r, w = named(reads, "r_"), named(writes, "w_")
    axes, of_r, of_w = B._grid(r, w, ndims)
    a, b = B._spread(r, "r_", axes, of_w, of_r), B._spread(w, "w_", axes, of_r, of_w)
    return a.join(b, [f"_{x}{i}" for i in axes for x in "mb"]).count(), a.count() + b.count()


def test_columns_and_long_boxes_meet_few(spark):
    """Columns over a whole axis, and one box over everything, among short ones."""
    n = 400
    columns = spark.range(n).selectExpr("id", "0L AS s0", "id * 5 AS s1", "100000L AS c0", "5L AS c1")
    shifted = spark.range(n).selectExpr("id", "0L AS s0", "id * 5 + 2 AS s1", "100000L AS c0", "5L AS c1")
    met, rows = candidates(spark, columns, shifted, 2)
    assert B.box_join(columns, shifted, 2).count() == 2 * n - 1 and met < 12 * n and rows < 5 * n
    rows_ = spark.range(n).selectExpr("id", "id * 7 AS s0", "0L AS s1", "7L AS c0", "9L AS c1")
    long = spark.createDataFrame([(-1, 0, 0, 1 << 40, 9)], rows_.schema)
    met, rows = candidates(spark, rows_, rows_.unionByName(long), 2)
    assert B.box_join(rows_, rows_.unionByName(long), 2).count() == 2 * n and met < 12 * n and rows < 9 * n


@pytest.mark.parametrize("ndims", [1, 3])
def test_join_of_mixed_lengths(spark, ndims):
    rnd = random.Random(ndims)
    made = lambda k: [([rnd.randrange(300) for _ in range(ndims)], [rnd.choice([0, 1, 2, 5, 17, 64, 65, 200, 4096]) for _ in range(ndims)]) for _ in range(k)]
    reads, writes = made(40), made(50)
    schema = ", ".join(["id long", *[f"{x}{i} long" for x in "sc" for i in range(ndims)]])
    f = lambda boxes: spark.createDataFrame([(k, *s, *c) for k, (s, c) in enumerate(boxes)], schema)
    got = [tuple(r) for r in B.box_join(f(reads), f(writes), ndims).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(reads, writes)
    empty = B.box_join(f(reads), f(writes).limit(0), ndims)
    assert empty.count() == 0


def test_clipping_in_two_axes(spark):
    writes = frame(spark, [((i, j), (2, 2)) for i in (0, 2) for j in (0, 2)])
    read = frame(spark, [((0, 0), (4, 4))])
    plan = B.box_join(read, writes, 2)
    assert sorted((r.lo0, r.lo1, r.hi0 - r.lo0, r.hi1 - r.lo1) for r in plan.collect()) == [(0, 0, 2, 2), (0, 2, 2, 2), (2, 0, 2, 2), (2, 2, 2, 2)]
    assert B.coverage(read, plan, 2).collect()[0].complete
    overlapping = B.box_join(read, writes.unionByName(writes.filter("id = 0")), 2)
    assert B.distinct_coverage(read, overlapping, 2).collect()[0].matched == 16
    assert not B.coverage(read, plan.filter("w_id > 0"), 2).collect()[0].complete


def test_no_nested_loop(spark):
    a = frame(spark, [((0, 0), (4, 4))] * 3)
    plan = B.box_join(a, a, 2, width=2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_runs_and_merging(spark):
    a = frame(spark, [((0, 0), (2, 5)), ((2, 0), (1, 3)), ((1, 2), (1, 4)), ((4, 1), (0, 3))])
    runs = B.runs(a, [5, 5], 1)
    assert sorted((r.id, r.offset, r.len, r.buf) for r in runs.collect()) == [(0, 0, 5, 0), (0, 5, 5, 5), (1, 10, 3, 0), (2, 7, 4, 0)]
    assert [(r.offset, r.len, r.n) for r in B.coalesce_runs(runs).collect()] == [(0, 13, 4)]
    strided = B.runs(a.filter("id = 1"), [5, 5], 1, [1, 2])
    assert sorted((r.offset, r.len) for r in strided.collect()) == [(10, 1), (12, 1), (14, 1)]


@pytest.mark.parametrize("seed", range(2))
def test_merging_in_ranges(spark, seed):
    rnd = random.Random(seed)
    pieces = [(rnd.randrange(400), rnd.randrange(1, 12)) for _ in range(40)]
    df = spark.createDataFrame(pieces, "offset long, len long")
    got = sorted((r.offset, r.len) for r in B.coalesce_runs_distributed(df, 32).collect())
    want = sorted((r.offset, r.len) for r in B.coalesce_runs(df).collect())
    covered = sorted({x for a, n in pieces for x in range(a, a + n)})
    assert got == want
    assert [x for a, n in got for x in range(a, a + n)] == covered


@pytest.mark.parametrize("pieces", [[(k * 3, 3) for k in range(500)], [(0, 1), (10**9, 5), (5, 40000), (39000, 7000), (10**9 + 5, 1)], [(7, 3)], []])
def test_merging_over_many_passes(spark, pieces):
    """Dense runs that become one, and runs far apart."""
    df = spark.createDataFrame(pieces, "offset long, len long")
    got = B.coalesce_runs_distributed(df, 16)
    assert sorted(map(tuple, got.collect())) == sorted((r.offset, r.len) for r in B.coalesce_runs(df).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_trimming_and_groups_against_plain_loops(spark, seed):
    rnd = random.Random(seed)
    pieces = [(k, rnd.choice([rnd.randrange(200), rnd.randrange(10**6)]), rnd.randrange(1, 30), 1000 * k) for k in range(150)]
    reach, want = None, []
    for k, at, n, buf in sorted(pieces, key=lambda p: (p[1], p[2], p[0])):
        cut = max(0, (at if reach is None else reach) - at)
        if cut < n:
            want.append((k, at + cut, n - cut, buf + cut))
        reach = max(reach or 0, at + n)
    df = spark.createDataFrame(pieces, "id long, offset long, len long, buf long")
    assert sorted(map(tuple, B.trim_runs(df).select("id", "offset", "len", "buf").collect())) == sorted(want)
    reach, group, groups = None, 0, {}
    for k, at, n, _ in sorted(pieces, key=lambda p: (p[1], p[2], p[0])):
        group += reach is None or at >= reach
        groups[k], reach = group, max(reach or 0, at + n)
    spans = df.selectExpr("id", "offset AS first", "offset + len AS end")
    assert {r.id: r.grp for r in B.interleave_groups(spans).collect()} == groups
    assert B.trim_runs(df.limit(0)).count() == 0 and B.interleave_groups(spans.limit(0)).count() == 0


def test_trimming_keeps_the_earlier_run(spark):
    df = spark.createDataFrame([(1, 0, 10, 0), (2, 4, 8, 0), (3, 5, 3, 0)], "id long, offset long, len long, buf long")
    assert sorted((r.id, r.offset, r.len, r.buf) for r in B.trim_runs(df).collect()) == [(1, 0, 10, 0), (2, 10, 2, 6)]


def test_owners(spark):
    a = frame(spark, [((0, 0), (10, 4)), ((7, 0), (1, 1))]).selectExpr("*", "5 as varid")
    cut = B.split_by_owner(a, 2, 12, 3)
    assert sorted((r.id, r.owner, r.s0, r.c0) for r in cut.collect()) == [(0, 0, 0, 4), (0, 1, 4, 4), (0, 2, 8, 2), (1, 1, 7, 1)]


def test_interleaved_groups(spark):
    spans = spark.createDataFrame([(1, 0, 10), (2, 5, 8), (3, 10, 12), (4, 20, 30)], "id long, first long, end long")
    groups = {r.id: r.grp for r in B.interleave_groups(spans).collect()}
    assert groups[1] == groups[2] and len(set(groups.values())) == 3


def test_every_point_of_the_grid_is_looked_up(spark, tmp_path):
    spark.range(1530).selectExpr("id AS o_orderkey", "id * 1.5 AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.point_id, r.box_id) for r in QUERIES["point_stab"](spark, str(tmp_path)).collect())
    assert got == [(k, k // 100 // 7 * 10 + k % 100 // 11) for k in range(1530)]  # tiles of 7 x 11, ten across
