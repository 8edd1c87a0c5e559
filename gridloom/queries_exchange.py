"""Queries over the driver tables for runs, delivered values, request queues, files and request logs; see :mod:`gridloom.queries`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.cast import byte_bits, checked_cast
from gridloom.operators import boxes as B
from gridloom.operators import fill as L
from gridloom.operators import reduce as R
from gridloom.operators import select as S
from gridloom.operators.chunks import read_subfiles, write_subfiles
from gridloom.plans import couple as C
from gridloom.plans.catalog import Dataset, Schema
from gridloom.plans.requests import RequestQueue, record_requests
from gridloom.queries import _DAY, _GRID, _TILE, _requests, _rows, _tilings, query
from gridloom.sources import cdf
from gridloom.tables import orders_grid, table, tiles


def scratch(spark: SparkSession) -> str:
    """A new place for files that every machine sees, for the queries that write one; a local folder only where all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or tempfile.gettempdir()).removeprefix('file://').rstrip('/')}/{uuid.uuid4().hex}"


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)


# runs and groups

_REACH = """max({end}) OVER (ORDER BY {at}, {ties} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_PIECES = '(SELECT o_orderkey AS id, o_custkey * 24 AS "offset", 1 + o_orderkey % 37 AS len, o_orderkey * 64 AS buf FROM orders)'


@query(f"""SELECT id, "offset" + cut AS "offset", len - cut AS len, buf + cut AS buf
  FROM (SELECT *, greatest(0, coalesce({_REACH.format(end='"offset" + len', at='"offset"', ties='len, id')}, "offset") - "offset") AS cut FROM {_PIECES}) WHERE cut < len""")
def trim_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that overlap, of which the earlier keep what is contested."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return B.trim_runs(o.select(key.alias("id"), (F.col("o_custkey") * 24).alias("offset"), (1 + key % 37).alias("len"), (key * 64).alias("buf")))


_SPANS = '(SELECT o_orderkey AS id, o_custkey * 24 AS "first", o_custkey * 24 + 1 + o_orderkey % 37 AS "end" FROM orders)'


@query(f"""SELECT id, "first", "end", CAST(sum(new) OVER (ORDER BY "first", "end", id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp
  FROM (SELECT *, CASE WHEN "first" < {_REACH.format(end='"end"', at='"first"', ties='"end", id')} THEN 0 ELSE 1 END AS new FROM {_SPANS})""")
def interleave_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of requests whose spans reach into each other."""
    first = F.col("o_custkey") * 24
    return B.interleave_groups(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first.alias("first"), (first + 1 + F.col("o_orderkey") % 37).alias("end")))


@query(f"""WITH g AS (SELECT unnest(range((SELECT (count(*) + 99) // 100 FROM orders))) AS d0), c AS (SELECT d0, d1,
    ((d0 // 7) * 10 + d1 // 11) % 5 <> 0 OR ((d0 // 9) * 8 + d1 // 13) % 3 = 0 AS held FROM g, (SELECT unnest(range(100)) AS d1))
  SELECT (d0 // 10) * 10 + d1 // 10 AS id, count(*) AS requested, count(*) FILTER (held) AS matched, bool_and(held) AS complete FROM c GROUP BY 1""")
def distinct_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads are covered by two sets of writes that overlap each other."""
    reads, writes = _tilings(spark, sf_dir)
    more = tiles(spark, _rows(spark, sf_dir), 100, 9, 13).filter("id % 3 = 0").withColumn("id", F.col("id") + 10_000_000)
    return B.distinct_coverage(reads, B.box_join(reads, writes.filter("id % 5 <> 0").unionByName(more), 2), 2)


_WIDE = """(SELECT r AS id, r * 100 AS s0, 0 AS s1, 100 AS c0, 1000 AS c1 FROM (SELECT unnest(range(40)) AS r) UNION ALL SELECT 100, 0, 17, 4000, 3)"""


@query(f"""SELECT w.id AS w_id, o_orderkey AS r_id, o_orderkey AS lo0, greatest(w.s1, o_custkey % 900) AS lo1, o_orderkey + 1 AS hi0, least(w.s1 + w.c1, o_custkey % 900 + 40) AS hi1
  FROM (SELECT * FROM orders) o JOIN {_WIDE} w ON o_orderkey >= w.s0 AND o_orderkey < w.s0 + w.c0 AND o_custkey % 900 < w.s1 + w.c1 AND w.s1 < o_custkey % 900 + 40""")
def box_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small boxes against bands over a whole axis and one very long box."""
    small = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("s0"), (F.col("o_custkey") % 900).alias("s1"), F.lit(1).cast("long").alias("c0"), F.lit(40).cast("long").alias("c1"))
    bands = spark.range(40).selectExpr("id", "id * 100 AS s0", "0L AS s1", "100L AS c0", "1000L AS c1")
    return B.box_join(small, bands.unionByName(spark.createDataFrame([(100, 0, 17, 4000, 3)], bands.schema)), 2)


@query("SELECT CAST((o_custkey % 7) % 3 AS BIGINT) AS owner, count(*) AS n, CAST(sum(1 + o_orderkey % 5) AS BIGINT) AS cells FROM orders GROUP BY 1")
def owner_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of rank 1, which go whole to the owner of their variable."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s0"), (1 + F.col("o_orderkey") % 5).alias("c0"), (F.col("o_custkey") % 7).alias("varid"))
    return B.split_by_owner(o, 1, 0, 3).groupBy("owner").agg(F.count("*").alias("n"), F.sum(B.size(1)).alias("cells"))


# delivery

_INDEXED = f"(SELECT epoch, event_id - lo AS i, value FROM events JOIN {_DAY} ON CAST(day(ts) AS BIGINT) = epoch)"


@query(f"SELECT 'r-' || epoch || '-' || ((i // 100) * 100) AS r_id, i AS d0, value FROM {_INDEXED}")
def transfer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's reads of 100 records get from its writes of 60."""
    log = _requests(spark, sf_dir)
    day = F.dayofmonth("ts").cast("long")
    first = table(spark, sf_dir, "events").groupBy(day.alias("epoch")).agg(F.min("event_id").alias("lo"))
    held = table(spark, sf_dir, "events").select(day.alias("epoch"), "event_id", "value").join(first, "epoch")
    i = F.col("event_id") - F.col("lo")
    cells = held.select(F.concat_ws("-", F.lit("w"), "epoch", i - i % 60).alias("w_id"), F.lit(1).alias("seq"), i.alias("d0"), "value")
    return C.deliver(C.match_plan(log, 1), cells, 1)


@query(f"""SELECT 'r-' || epoch || '-' || ((i // 100) * 100) AS id, least(100, max(n) - min(i // 100) * 100) AS requested, count(*) AS received FROM
  (SELECT epoch, i, n FROM {_INDEXED} JOIN (SELECT epoch AS e, hi - lo AS n FROM {_DAY}) ON e = epoch) GROUP BY epoch, i // 100""")
def transfer_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that each read asked for and got."""
    got = transfer_values(spark, sf_dir).groupBy(F.col("r_id").alias("id")).agg(F.count("*").alias("received"))
    return C.reads(_requests(spark, sf_dir)).select("id", F.col("c0").alias("requested")).join(got, "id")


# request queues


def _queue(spark: SparkSession, sf_dir: str) -> RequestQueue:
    n = _rows(spark, sf_dir)
    s = Schema()
    s.def_dim("y", 0)
    s.def_dim("x", 100)
    s.def_var("price", "double", ["y", "x"])
    s.enddef()
    s.numrecs = n
    return RequestQueue(Dataset(s, {"price": orders_grid(spark, sf_dir)}))


@query(f"""SELECT CAST(1 AS BIGINT) AS req_id, (d0 - 2) * 20 + d1 - 10 AS place, value FROM {_GRID} WHERE d0 BETWEEN 2 AND 6 AND d1 BETWEEN 10 AND 29
  UNION ALL SELECT 2, d0 * 50 + d1 // 2, value FROM {_GRID} WHERE d0 < 8 AND d1 % 2 = 0
  UNION ALL SELECT 3, d1 * 4 + d0 - 1, value FROM {_GRID} WHERE d0 BETWEEN 1 AND 4
  UNION ALL SELECT 4, CASE WHEN d0 = 0 THEN d1 ELSE 100 + (d0 - 3) * 5 + d1 - 90 END, value FROM {_GRID} WHERE d0 = 0 OR d0 BETWEEN 3 AND 4 AND d1 BETWEEN 90 AND 94
  UNION ALL SELECT 5, 0, value FROM {_GRID} WHERE d0 = 9 AND d1 = 9
  UNION ALL SELECT 7, d0 * 100 + d1, value FROM {_GRID}""")
def queue_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of posted reads and a cancelled one, answered by one plan."""
    q = _queue(spark, sf_dir)
    q.iget("price", [2, 10], [5, 20])
    q.iget("price", [0, 0], [8, 50], [1, 2])
    q.iget("price", [1, 0], [4, 100], imap=[1, 4])
    q.iget_n("price", [[0, 0], [3, 90]], [[1, 100], [2, 5]])
    q.iget1("price", [9, 9])
    gone = q.iget("price", [0, 0], [3, 3])
    q.iget("price")
    q.cancel([gone])
    return q.wait()[0]


@query(f"""SELECT d0, d1, CASE WHEN d0 = 5 AND d1 = 5 THEN -5.0 WHEN d0 BETWEEN 3 AND 4 AND d1 < 10 THEN -((d0 - 3) * 10 + d1) - 300.0 WHEN d0 = 1 AND d1 BETWEEN 20 AND 24 THEN 20 - d1 - 200.0
    WHEN d0 <= 2 AND d1 BETWEEN 0 AND 49 AND d1 % 2 = 0 THEN -1.0 ELSE value END AS value FROM {_GRID}
  UNION ALL SELECT CAST(n AS BIGINT), CAST(j AS BIGINT), -4.0 FROM (SELECT (count(*) + 99) // 100 + 1 AS n FROM orders), (SELECT unnest(range(100)) AS j)""")
def queue_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted and buffered writes of several forms, the later counting where they meet, and one that extends the records; the whole variable after it."""
    q = _queue(spark, sf_dir)
    n = _rows(spark, sf_dir)
    q.iput("price", L.grid(spark, [3, 25]).withColumn("value", F.lit(-1.0)), [0, 0], [3, 25], [1, 2])
    places = spark.range(5).select(F.col("id").alias("place"), (-F.col("id") - 200.0).alias("value"))
    q.attach(4096)
    q.bput_n("price", places, [[1, 20], [1, 22]], [[1, 2], [1, 3]])
    turned = spark.range(20).select(((F.col("id") % 10) * 2 + F.floor(F.col("id") / 10)).alias("place"), (-F.col("id") - 300.0).alias("value"))
    q.bput("price", turned, [3, 0], [2, 10], imap=[1, 2])
    q.iput1("price", [5, 5], -5.0)
    q.iput("price", L.grid(spark, [1, 100]).withColumn("value", F.lit(-4.0)), [n + 1, 0], [1, 100])
    q.wait()
    q.detach()
    return q.dataset.var("price")


@query(f"SELECT epoch, s0 + k AS s0, CAST(1 AS BIGINT) AS c0 FROM (SELECT epoch, s0, unnest(range(least(60, n - s0))) AS k FROM (SELECT epoch, hi - lo AS n, unnest(range(0, hi - lo, 60)) AS s0 FROM {_DAY}))")
def record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write requests on records as one for each record."""
    return record_requests(C.writes(_requests(spark, sf_dir))).select("epoch", "s0", "c0")


@query(f"SELECT id, c0 * c1 AS n, c0 * c1 * 8 AS bytes FROM {_TILE.format(h=7, w=11)}")
def request_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.request_bytes(_tilings(spark, sf_dir)[1].select("id", F.array("c0", "c1").alias("count")), "double").select("id", "n", "bytes")


@query("SELECT CAST(sum(CASE WHEN event_id % 3 = 0 THEN user_id END) AS BIGINT) AS put_size, CAST(sum(CASE WHEN event_id % 3 <> 0 THEN user_id END) AS BIGINT) AS get_size FROM events")
def moved_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "w").otherwise("r").alias("rw"), F.col("user_id").alias("bytes"))
    return R.moved(log)


@query("SELECT l_returnflag AS \"group\", count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_done, bool_and(l_linestatus = 'F') AS all_done FROM lineitem GROUP BY 1")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.done(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), (F.col("l_linestatus") == "F").alias("done")))


@query(f"SELECT (d0 - 2) * 50 + d1 - 10 AS place, value FROM {_GRID} WHERE d0 BETWEEN 2 AND 11 AND d1 BETWEEN 10 AND 59 AND (d0 - 2) * 50 + d1 - 10 < 320")
def flexible_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of 500 elements into a buffer of 320."""
    box = S.vara(orders_grid(spark, sf_dir), [2, 10], [10, 50]).select((F.col("d0") * 50 + F.col("d1")).alias("place"), "value")
    return S.flexible(box, 500, 320)[0]


# conversions

_SIGNED = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) * 5 - 128 AS x FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, CAST((x + 256) % 256 AS SMALLINT) AS bits, CAST(x AS TINYINT) AS back FROM {_SIGNED}")
def cast_byte_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed bytes as the unsigned ones of the same bits, and back."""
    signed = (F.col("l_quantity").cast("int") * 5 - 128).cast("byte")
    bits = byte_bits(signed, True)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.alias("bits"), byte_bits(bits, False).alias("back"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0 THEN CAST(x AS SMALLINT) END AS value, x < 0 AS erange FROM {_SIGNED}")
def cast_signed_ubyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The external unsigned byte checks its range against signed ones."""
    value, erange = checked_cast(F.col("l_quantity").cast("int") * 5 - 128, "ubyte", "byte")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), erange.alias("erange"))


# files


def _file(spark: SparkSession, sf_dir: str) -> str:
    """The orders grid, filled to whole rows, and the customers' balances as records, in one classic file."""
    n, path = _rows(spark, sf_dir), f"{scratch(spark)}.nc"
    s = Schema(2)
    s.def_dim("t", 0)
    s.def_dim("y", n)
    s.def_dim("x", 100)
    s.def_var("price", "double", ["y", "x"])
    s.def_var("balance", "float", ["t"])
    s.def_var("nation", "short", ["t"])
    s.def_var_fill("price", False, -1.0)
    c = table(spark, sf_dir, "customer").withColumn("d0", F.col("c_custkey") - table(spark, sf_dir, "customer").agg(F.min("c_custkey")).first()[0])
    data = {"price": orders_grid(spark, sf_dir), "balance": c.select("d0", F.col("c_acctbal").alias("value")), "nation": c.select("d0", F.col("c_nationkey").alias("value"))}
    cdf.write_dataset(Dataset(s, data), path)
    _gone_at_exit(spark, path)
    return path


@query(f"""SELECT i.d0, j.d1, coalesce(g.value, -1.0) AS value FROM (SELECT unnest(range((SELECT (count(*) + 99) // 100 FROM orders))) AS d0) i CROSS JOIN (SELECT unnest(range(100)) AS d1) j
  LEFT JOIN {_GRID} g ON g.d0 = i.d0 AND g.d1 = j.d1""")
def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable written to a file by tasks, with its fill, and read back."""
    return cdf.open_dataset(spark, _file(spark, sf_dir)).var("price")


@query(f"SELECT (d0 - 3) // 2 AS d0, d1 - 50 AS d1, value FROM {_GRID} WHERE d0 BETWEEN 3 AND 7 AND d0 % 2 = 1 AND d1 >= 50")
def file_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a file; its bounds on the first axis decide which bytes are read."""
    return cdf.box(spark, _file(spark, sf_dir), "price", [3, 50], [3, 50], [2, 1])


@query("SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS d0, CAST(c_acctbal AS FLOAT) AS balance, CAST(c_nationkey AS SMALLINT) AS nation FROM customer")
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two record variables, interleaved in the file."""
    d = cdf.open_dataset(spark, _file(spark, sf_dir))
    return d.var("balance").withColumnRenamed("value", "balance").join(d.var("nation").withColumnRenamed("value", "nation"), "d0")


@query(f"SELECT d0 - 4 AS d0, d1, value FROM {_GRID} WHERE d0 BETWEEN 4 AND 9")
def subfile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a variable that is split over four files along its first axis; only the files that hold it are read."""
    n, path = _rows(spark, sf_dir), scratch(spark)
    write_subfiles(orders_grid(spark, sf_dir), path, [n, 100], 0, 4)
    _gone_at_exit(spark, path)
    return S.rebased(read_subfiles(spark, path, 4, 6, n, 4).select("d0", "d1", "value"), [4, 0])
