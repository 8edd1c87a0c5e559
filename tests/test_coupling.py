import pytest
from pyspark.sql import functions as F

from gridloom.operators import fill as L
from gridloom.plans import couple as C
from gridloom.plans.catalog import Dataset, Schema
from gridloom.plans.errors import ArrayError, StallError
from gridloom.plans.requests import ALL_GETS, RequestQueue, record_requests
from gridloom.streaming import exchange as X

CONFIG = """
[INFO]
ncomp = 2
comp_name = "Writer"
comp_name = "reader"   # the second
iodb_build_mode = range

[FILE]
filename = "wave"
exclude_name = "wave_old"
comp1 = writer
comp2 = reader
mode = transfer
replay_io = 1

[FILE]
filename = "restart%.nc"
comp1 = writer
comp2 = reader
mode = file
replay_io = 1
"""


def test_config():
    c = C.parse_config(CONFIG)
    assert c.components == ["writer", "reader"] and [r.mode for r in c.rules] == ["transfer", "file"]
    assert c.rules[0].replay and not c.rules[1].replay
    assert c.rule_for("my_WAVE.nc").pattern == "wave" and c.rule_for("wave_old.nc") is None
    assert c.rule_for("restart.0007.nc").mode == "file" and c.rule_for("else") is None
    for bad in ("[INFO]\nspeed = 3\n", CONFIG.replace("ncomp = 2", "ncomp = 3"), CONFIG.replace("mode = file", "mode = fast"), CONFIG.replace("replay_io = 1", "replay_io = yes")):
        with pytest.raises(C.ConfigError):
            C.parse_config(bad)


SCHEMA = "req_id string, component string, rank long, varid int, rw string, epoch long, seq long, s0 long, s1 long, c0 long, c1 long"


def requests(spark, epochs=(0,), skip=()):
    rows = []
    for e in epochs:
        rows += [(f"w{e}-{k}", "writer", k, 0, "w", e, k, i, j, 2, 2) for k, (i, j) in enumerate([(0, 0), (0, 2), (2, 0), (2, 2)]) if k not in skip]
        rows += [(f"r{e}", "reader", 0, 0, "r", e, 9, 0, 0, 4, 4), (f"s{e}", "reader", 1, 0, "r", e, 9, 1, 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


def cells(spark, log):
    w = log.filter("rw = 'w'")
    for i in range(2):
        w = w.withColumn(f"d{i}", F.explode(F.expr(f"sequence(s{i}, s{i} + c{i} - 1)")))
    return w.select(F.col("req_id").alias("w_id"), "seq", "d0", "d1", (F.col("epoch") * 100 + F.col("d0") * 4 + F.col("d1")).alias("value"))


def test_transfer_and_replay(spark):
    log = requests(spark, (0, 1))
    twice = log.unionByName(log)  # announced again: counts once
    c = C.Coupler(spark, C.parse_config(CONFIG), "Writer")
    first = c.transfer("wave.nc", twice, cells(spark, log), 2)
    assert first.incomplete().count() == 0
    got = {(r.r_id, r.d0, r.d1): r.value for r in first.delivered.collect()}
    assert len(got) == 16 + 6 and all(v == d0 * 4 + d1 for (_, d0, d1), v in got.items())
    second = c.transfer("wave.nc", twice, cells(spark, log), 2)
    want = {tuple(r) for r in C.match_plan(log.filter("epoch = 1"), 2).collect()}
    assert {tuple(r) for r in second.plan.collect()} == want and c.epochs["wave.nc"] == 2
    assert c.close("wave.nc") and not c.patterns
    with pytest.raises(C.ConfigError):
        c.transfer("restart.1.nc", log, cells(spark, log), 2)


def test_overlapping_writes(spark):
    log = requests(spark).unionByName(spark.createDataFrame([("w0-9", "writer", 9, 0, "w", 0, 9, 1, 1, 2, 2)], SCHEMA))
    data = cells(spark, requests(spark)).unionByName(cells(spark, log.filter("req_id = 'w0-9'")).withColumn("value", F.lit(-1).cast("long")))
    plan = C.match_plan(log, 2)
    newest = {(r.d0, r.d1): r.value for r in C.deliver(plan, data, 2).filter("r_id = 'r0'").collect()}
    assert newest[1, 1] == -1 and newest[0, 0] == 0
    oldest = {(r.d0, r.d1): r.value for r in C.deliver(plan, data, 2, "first").filter("r_id = 'r0'").collect()}
    assert oldest[1, 1] == 5
    c = C.Coupler(spark, C.parse_config(CONFIG), "reader")
    with pytest.raises(ArrayError):
        c.transfer("wave.nc", log, data, 2, on_overlap="error")


def test_uncovered_reads_are_reported(spark):
    log = requests(spark, skip=(3,))
    c = C.Coupler(spark, C.parse_config(CONFIG), "reader")
    out = c.transfer("wave.nc", log, cells(spark, log), 2)
    assert {(r.id, r.requested, r.matched) for r in out.incomplete().collect()} == {("r0", 16, 12), ("s0", 6, 4)}


def test_stream_waits_for_missing_writes(spark, tmp_path):
    source = tmp_path / "in"
    whole = requests(spark, (0, 1))
    source.mkdir()
    whole.filter("req_id <> 'w0-3'").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(whole.schema).parquet(str(source))
        q = X.stream_transfers(stream, 2, str(tmp_path / "state"), str(tmp_path / "check"))
        q.awaitTermination(120)

    run()
    done = {r.r_id for r in spark.read.parquet(str(tmp_path / "state/plans")).collect()}
    assert done == {"r1", "s1"}
    assert {r.epoch for r in X.pending(spark, str(tmp_path / "state"), 0).collect()} == {0}
    whole.filter("req_id = 'w0-3'").coalesce(1).write.mode("append").parquet(str(source))
    run()  # a restart from the checkpoint
    plans = spark.read.parquet(str(tmp_path / "state/plans"))
    assert {r.r_id for r in plans.collect()} == {"r0", "s0", "r1", "s1"}
    assert X.pending(spark, str(tmp_path / "state"), 1).count() == 0


def test_late_requests(spark):
    now, late = X.drop_late(requests(spark, (0, 1)), 0)
    assert {r.epoch for r in now.collect()} == {1} and {r.epoch for r in late.collect()} == {0}


def test_gate(spark, tmp_path):
    assert not X.written_gate(spark, str(tmp_path / "w"))
    spark.range(1).write.parquet(str(tmp_path / "w"))
    assert X.written_gate(spark, str(tmp_path / "w"))


def test_request_queue(spark):
    s = Schema()
    s.def_dim("t", 0)
    s.def_dim("x", 4)
    s.def_var("v", "int", ["t", "x"])
    s.enddef()
    s.numrecs = 2
    d = Dataset(s, {"v": L.grid(spark, [2, 4]).withColumn("value", (F.col("d0") * 4 + F.col("d1")).cast("int"))})
    q = RequestQueue(d)
    one = q.iget("v", [0, 1], [2, 2])
    many = q.iget_n("v", [[0, 0], [1, 2]], [[1, 2], None])
    gone = q.iget("v")
    assert q.cancel([gone, 99]) == {gone: "NC_NOERR", 99: "NC_EINVAL_REQUEST"}
    values = L.grid(spark, [1, 4]).withColumn("value", F.lit(-1))
    q.iput("v", values, [2, 0], [1, 4])
    with pytest.raises(ArrayError, match="NC_ENULLABUF"):
        q.bput("v", values, [0, 0], [1, 4])
    q.attach(16)
    b = q.bput("v", values.withColumn("value", F.lit(-2)), [0, 0], [1, 4])
    with pytest.raises(ArrayError, match="NC_EINSUFFBUF"):
        q.bput("v", values, [0, 0], [1, 4])
    with pytest.raises(ArrayError, match="NC_EPENDINGBPUT"):
        q.detach()
    with pytest.raises(ArrayError, match="NC_EINVALCOORDS"):
        q.iget("v", [2, 0], [1, 1])
    reads, status = q.wait(ALL_GETS)
    assert set(status.values()) == {"NC_NOERR"} and q.count() == 2
    assert [(r.req_id, r.value) for r in reads.orderBy("req_id", "place").collect()] == [(one, 1), (one, 2), (one, 5), (one, 6), (many, 0), (many, 1), (many, 6)]
    q.wait()
    q.detach()
    assert s.numrecs == 3 and b and sorted((r.d0, r.value) for r in d.data["v"].collect()) == [(0, -2)] * 4 + [(1, x) for x in range(4, 8)] + [(2, -1)] * 4


def test_record_requests(spark):
    df = spark.createDataFrame([(1, 3, 2, 0, 4), (2, 0, 0, 0, 4)], "req_id long, s0 long, c0 long, s1 long, c1 long")
    assert sorted((r.req_id, r.s0, r.c0) for r in record_requests(df).collect()) == [(1, 3, 1), (1, 4, 1)]


def test_replay_of_a_changed_pattern(spark):
    """Reads that were not there when the pattern was recorded are matched anew."""
    log = requests(spark, (0, 1)).unionByName(spark.createDataFrame([("new", "reader", 5, 0, "r", 1, 9, 1, 0, 3, 2)], SCHEMA))
    c = C.Coupler(spark, C.parse_config(CONFIG), "writer")
    c.transfer("wave.nc", log, cells(spark, log), 2)
    second = c.transfer("wave.nc", log, cells(spark, log), 2)
    assert second.incomplete().count() == 0 and second.delivered.filter("r_id = 'new'").count() == 6
    assert {tuple(r) for r in second.plan.collect()} == {tuple(r) for r in C.match_plan(log.filter("epoch = 1"), 2).collect()}


def test_of_differing_announcements_the_newest_counts(spark):
    a = requests(spark).filter("req_id = 'r0'")
    log = a.unionByName(a.withColumns({"seq": F.lit(11).cast("long"), "c0": F.lit(1).cast("long")})).unionByName(a)
    assert [(r.seq, r.c0) for r in C.announced(log).collect()] == [(11, 1)] and C.announced(log).columns == log.columns


def test_epochs_until_the_reader_is_done(spark, tmp_path):
    config = C.parse_config(CONFIG.replace("[INFO]", "[INFO]\nlog_ioreqs = 1", 1))
    writer, reader = (C.Coupler(spark, config, c, str(tmp_path)) for c in ("writer", "reader"))
    log = requests(spark, range(3))

    def served(k, out):
        assert out.incomplete().count() == 0
        if k == 1:
            reader.complete_multiple("wave.nc")

    assert writer.transfer_multiple("wave.nc", lambda k: (log, cells(spark, log)), 2, served) == 2
    with pytest.raises(C.ConfigError):
        writer.complete_multiple("wave.nc")
    with pytest.raises(C.ConfigError):  # a component that writes nothing
        C.Coupler(spark, config, "reader", str(tmp_path / "other")).transfer_multiple("wave.nc", lambda k: (log, cells(spark, log)), 2)
    with pytest.raises(StallError):
        C.Coupler(spark, config, "writer", str(tmp_path / "other")).transfer_multiple("wave.nc", lambda k: None, 2, timeout=0.3)
    audit = writer.audit()
    assert audit.count() == 12 and {(r.dataset, r.epoch) for r in audit.collect()} == {("wave.nc", 0), ("wave.nc", 1)}
    times = {r.what: (r.calls, r.seconds) for r in writer.finalize().collect()}
    assert times["transfer wave.nc"][0] == 2 and times["finalize"][1] >= 0
    assert reader.peer_finished("wave.nc") and not writer.peer_finished("wave.nc") and reader.audit().count() == 0
    with pytest.raises(C.ConfigError):
        writer.transfer("wave.nc", log, cells(spark, log), 2)
    with pytest.raises(C.ConfigError):
        writer.finalize()
    assert reader.transfer_multiple("wave.nc", lambda k: None, 2) == 0  # the peer has ended


def test_stalls(spark, tmp_path):
    assert X.wait_until(lambda: 0, lambda: True)
    with pytest.raises(StallError):
        X.wait_until(lambda: 0, lambda: False, 0.2, 0.05)
    steps = iter(range(100))
    assert X.wait_until(lambda: next(steps), lambda: next(steps) > 10, 0.2, 0.01)
    assert not X.await_written(spark, str(tmp_path / "never"), 0.2, 0.05, ignore=True)
    source, whole = tmp_path / "in", requests(spark, (0,))
    source.mkdir()
    whole.filter("req_id <> 'w0-3'").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(whole.schema).parquet(str(source))
    state = str(tmp_path / "state")
    q = X.stream_transfers(stream, 2, state, str(tmp_path / "check"), available_now=False)
    with pytest.raises(StallError):
        X.await_complete(q, state, timeout=12, poll=0.2)
    assert not q.isActive
    c = C.Coupler(spark, C.parse_config(CONFIG), "writer")
    q = c.watch(X.stream_transfers(stream, 2, state, str(tmp_path / "check"), available_now=False))
    whole.filter("req_id = 'w0-3'").coalesce(1).write.mode("append").parquet(str(source))
    assert X.await_complete(q, state, timeout=60, poll=0.2)
    c.finalize()
    assert not q.isActive


def test_schema_hand_off(spark):
    s = Schema(2)
    s.def_dim("t", 0)
    s.def_dim("x", 4)
    s.def_var("v", "int", ["t", "x"])
    s.put_att("v", "units", "char", "K")
    s.enddef()
    s.numrecs = 3
    got = C.schema_of(C.schema_frame(spark, "wave.nc", s), "wave.nc")
    assert got.shape("v") == [3, 4] and got.get_att("v", "units") == "K" and got.version == 2
    with pytest.raises(ArrayError, match="NC_ENOENT"):
        C.schema_of(C.schema_frame(spark, "wave.nc", s), "other")


def test_requests_in_define_mode_and_in_other_layouts(spark):
    s = Schema()
    s.def_dim("y", 3)
    s.def_dim("x", 4)
    s.def_var("v", "int", ["y", "x"])
    d = Dataset(s, {"v": L.grid(spark, [3, 4]).withColumn("value", (F.col("d0") * 4 + F.col("d1")).cast("int"))})
    q = RequestQueue(d)
    turned = q.iget("v", [0, 0], [3, 4], imap=[1, 3])
    wrong = q.iget("v", [9, 0], [1, 1])
    one = q.iget1("v", [2, 3])
    with pytest.raises(ArrayError, match="NC_EINDEFINE"):
        q.wait()
    s.enddef()
    reads, status = q.wait()
    assert status == {turned: "NC_NOERR", wrong: "NC_EINVALCOORDS", one: "NC_NOERR"} and q.count() == 0
    got = {(r.req_id, r.place): r.value for r in reads.collect()}
    assert [got[turned, k] for k in range(12)] == [0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11] and got[one, 0] == 11 and len(got) == 13
    values = spark.range(6).selectExpr("id AS place", "CAST(-id AS INT) AS value")
    q.attach(24)
    q.bput_n("v", values, [[0, 0], [0, 1], [2, 3]], [[1, 2], [1, 3], None])
    assert q.usage() == 24
    q.iput("v", spark.range(4).selectExpr("id AS place", "CAST(90 + id AS INT) AS value"), [1, 0], [2, 2], imap=[1, 2])
    q.iput1("v", [1, 3], 77)
    q.wait()
    rows = [[0] * 4 for _ in range(3)]
    for r in d.var("v").collect():
        rows[r.d0][r.d1] = r.value
    assert rows == [[0, -2, -3, -4], [90, 92, 6, 77], [91, 93, 10, -5]]
