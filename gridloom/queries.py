"""Queries over the driver tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.cast import checked_cast
from gridloom.functions.index import linear, owner_block, owner_cyclic, unravel
from gridloom.operators import boxes as B
from gridloom.operators import fill as L
from gridloom.operators import reduce as R
from gridloom.operators import select as S
from gridloom.operators.chunks import chunk_box as chunk_select
from gridloom.operators.chunks import reshape, to_chunks
from gridloom.operators.diff import diff_summary, diff_values
from gridloom.plans import couple as C
from gridloom.plans.catalog import Dataset, Schema, catalog_frames, consistency
from gridloom.streaming.exchange import drop_late
from gridloom.tables import embeddings, orders_1d, orders_grid, table, tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_GRID = "(SELECT o_orderkey // 100 AS d0, o_orderkey % 100 AS d1, o_totalprice AS value FROM orders)"
_EMB = "(SELECT vec_id AS d0, unnest(range(len(embedding))) AS d1, unnest(embedding) AS value FROM embeddings)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the orders grid, all of which are full but the last."""
    return -(-table(spark, sf_dir, "orders").count() // 100)


@query(f"""SELECT d0, CAST(round(sum(CAST(value AS DOUBLE)), 4) AS DOUBLE) AS checksum, count(*) AS n
  FROM (SELECT (d0 - 10) // 3 AS d0, value FROM {_EMB} WHERE d0 >= 10 AND d0 <= 10 + 99 * 3 AND (d0 - 10) % 3 = 0 AND d1 >= 4 AND d1 <= 4 + 24 * 2 AND (d1 - 4) % 2 = 0)
  GROUP BY d0""")
def box_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strided box of the embeddings, cast to double, summed by row."""
    box = S.vars_(embeddings(spark, sf_dir), [10, 4], [100, 25], [3, 2])
    value, _ = checked_cast(F.col("value"), "double", "float")
    return box.withColumn("value", value).groupBy("d0").agg(F.round(F.sum("value"), 4).alias("checksum"), F.count("*").alias("n"))


@query("SELECT o_totalprice AS value FROM orders WHERE o_orderkey = 77")
def sel_var1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.var1(orders_1d(spark, sf_dir), [77])


@query("SELECT o_orderkey AS d0, o_totalprice AS value FROM orders")
def sel_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.var(orders_1d(spark, sf_dir))


@query(f"SELECT d0 - 2 AS d0, d1 - 10 AS d1, value FROM {_GRID} WHERE d0 BETWEEN 2 AND 11 AND d1 BETWEEN 10 AND 59")
def sel_vara(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vara(orders_grid(spark, sf_dir), [2, 10], [10, 50])


@query(f"SELECT (d0 - 1) // 3 AS d0, (d1 - 5) // 2 AS d1, value FROM {_GRID} WHERE d0 BETWEEN 1 AND 10 AND (d0 - 1) % 3 = 0 AND d1 BETWEEN 5 AND 63 AND (d1 - 5) % 2 = 0")
def sel_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vars_(orders_grid(spark, sf_dir), [1, 5], [4, 30], [3, 2])


@query(f"SELECT d0, d1, d1 * (SELECT count(*) FROM embeddings) + d0 AS m, value FROM {_EMB}")
def sel_varm_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in the order of axes 1, 0: the index map of the whole transposed buffer."""
    n = table(spark, sf_dir, "embeddings").count()
    return S.varm(embeddings(spark, sf_dir), [0, 0], [n, 64], None, [1, n])


@query(f"SELECT d1 AS d0, d0 AS d1, value FROM {_EMB}")
def transpose_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.transposed(embeddings(spark, sf_dir), [1, 0])


@query(f"SELECT d0 - 2 AS d0, d1 - 2 AS d1, value FROM {_GRID} WHERE d0 >= 2 AND d0 < (SELECT (count(*) + 99) // 100 - 2 FROM orders) AND d1 BETWEEN 2 AND 97")
def sel_varm_ghost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_halo(orders_grid(spark, sf_dir), [_rows(spark, sf_dir), 100], 2)


_LIST = [([0, 0], [3, 40]), ([2, 30], [4, 30]), ([5, 5], None), ([2, 30], [4, 30]), ([7, 0], [0, 9])]


@query(f"""SELECT CAST(seq AS BIGINT) AS seq, d0 - s0 AS d0, d1 - s1 AS d1, (d0 - s0) * c1 + (d1 - s1) AS place, value
  FROM {_GRID}, (VALUES (0, 0, 0, 3, 40), (1, 2, 30, 4, 30), (2, 5, 5, 1, 1), (3, 2, 30, 4, 30), (4, 7, 0, 0, 9)) AS b(seq, s0, s1, c0, c1)
  WHERE d0 >= s0 AND d0 < s0 + c0 AND d1 >= s1 AND d1 < s1 + c1""")
def sel_varn(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, counts = zip(*_LIST, strict=True)
    return S.varn(orders_grid(spark, sf_dir), starts, counts)


@query(f"SELECT d0, d1, d0 * 100 + d1 AS place, value FROM {_GRID} WHERE (d0 * 100 + d1) % 7 = 0")
def sel_vard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh place, to the grid's end."""
    places = spark.range(0, _rows(spark, sf_dir) * 100, 7).select(F.col("id").alias("place"))
    return S.vard(orders_grid(spark, sf_dir), [0, 100], places)


@query(f"""SELECT CAST(0 AS BIGINT) AS req_id, d0 - 1 AS d0, d1 AS d1, value FROM {_GRID} WHERE d0 = 1
  UNION ALL SELECT 1, d0 - 3, d1 - 50, value FROM {_GRID} WHERE d0 BETWEEN 3 AND 4 AND d1 >= 50""")
def sel_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders_grid(spark, sf_dir)
    return S.many([(0, S.vara(g, [1, 0], [1, 100])), (1, S.vara(g, [3, 50], [2, 50]))])


@query(f"SELECT d0, d1, CASE WHEN d0 BETWEEN 1 AND 2 AND d1 BETWEEN 0 AND 9 THEN -1.0 WHEN d0 BETWEEN 0 AND 1 AND d1 BETWEEN 5 AND 19 THEN -2.0 ELSE value END AS value FROM {_GRID}")
def put_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes that overlap, the later one (seq 2) counting."""
    g = orders_grid(spark, sf_dir)
    one = L.grid(spark, [2, 15], [0, 5]).withColumns({"value": F.lit(-2.0), "seq": F.lit(1)})
    two = L.grid(spark, [2, 10], [1, 0]).withColumns({"value": F.lit(-1.0), "seq": F.lit(2)})
    return S.put(g, one.unionByName(two), 2)


@query("""SELECT ((o_orderkey % 100) // 8) % 4 AS owner, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def part_block_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders_grid(spark, sf_dir).withColumn("owner", owner_cyclic(F.col("d1"), 4, 8))
    return g.groupBy("owner").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT (o_orderkey // 100) // CAST(ceil((SELECT (count(*) + 99) // 100 FROM orders) / 6.0) AS BIGINT) AS owner0, (o_orderkey % 100) // 34 AS owner1, count(*) AS n FROM orders GROUP BY 1, 2""")
def part_block_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders_grid(spark, sf_dir)
    owners = {"owner0": owner_block(F.col("d0"), _rows(spark, sf_dir), 6), "owner1": owner_block(F.col("d1"), 100, 3)}
    return g.withColumns(owners).groupBy("owner0", "owner1").agg(F.count("*").alias("n"))


@query("SELECT (o_orderkey % 100) % 5 AS owner, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def part_column_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders_grid(spark, sf_dir).withColumn("owner", owner_cyclic(F.col("d1"), 5))
    return g.groupBy("owner").agg(F.count("*").alias("n"), F.max(linear([F.col("d0"), F.col("d1")], [0, 100])).alias("last"))


@query("SELECT o_orderkey AS place, o_orderkey // 200 AS d0, (o_orderkey // 20) % 10 AS d1, o_orderkey % 20 AS d2, o_orderkey AS again FROM orders")
def index_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"))
    out = o.select("place", *[x.alias(f"d{i}") for i, x in enumerate(unravel(F.col("place"), [0, 10, 20]))])
    return out.withColumn("again", linear([F.col("d0"), F.col("d1"), F.col("d2")], [0, 10, 20]))


@query("""SELECT o_orderkey AS d0, CASE WHEN x BETWEEN -32768 AND 32767 THEN CAST(trunc(x) AS SMALLINT) END AS value, NOT x BETWEEN -32768 AND 32767 AS erange
  FROM (SELECT o_orderkey, o_totalprice - 50000 AS x FROM orders)""")
def cast_checked_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_1d(spark, sf_dir).withColumn("value", F.col("value") - 50000)
    value, erange = checked_cast(F.col("value"), "short")
    return v.select("d0", value.alias("value"), erange.alias("erange"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x BETWEEN 0 AND 255 THEN CAST(trunc(x) AS SMALLINT) END AS value, NOT x BETWEEN 0 AND 255 AS erange
  FROM (SELECT l_orderkey, l_linenumber, l_quantity * 7.5 - 20 AS x FROM lineitem)""")
def cast_checked_ubyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, erange = checked_cast(F.col("l_quantity") * 7.5 - 20, "ubyte")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), erange.alias("erange"))


@query("""SELECT event_id, x > 3.4028234663852886e38 OR x < -3.4028234663852886e38 AS erange,
  CAST(CASE WHEN x > 3.4028234663852886e38 THEN 3.4028234663852886e38 WHEN x < -3.4028234663852886e38 THEN -3.4028234663852886e38 ELSE x END AS FLOAT) AS value
  FROM (SELECT event_id, value * 1e37 AS x FROM events)""")
def cast_clamp_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, erange = checked_cast(F.col("value") * 1e37, "float")
    return table(spark, sf_dir, "events").select("event_id", erange.alias("erange"), value.alias("value"))


@query("""SELECT bool_or(x < 0) AS erange, count(*) FILTER (x < 0) AS n_bad FROM (SELECT c_acctbal AS x FROM customer)""")
def cast_status_uint(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, erange = checked_cast(F.col("c_acctbal"), "uint")
    return table(spark, sf_dir, "customer").select(value.alias("value"), erange.alias("erange")).agg(F.bool_or("erange").alias("erange"), F.count_if("erange").alias("n_bad"))


_CONV = "(SELECT conv_id AS d0, CAST(turn AS BIGINT) AS d1, CAST(length(text) AS INT) AS value FROM conversations)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("d0"), F.col("turn").alias("d1"), F.length("text").alias("value"))


@query(f"""SELECT i.d0, j.d1, coalesce(c.value, -2147483647) AS value, c.value IS NULL AS is_fill
  FROM (SELECT unnest(range((SELECT max(conv_id) + 1 FROM conversations))) AS d0) i CROSS JOIN (SELECT unnest(range(8)) AS d1) j LEFT JOIN {_CONV} c USING (d0, d1)""")
def fill_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _conversations(spark, sf_dir)
    n = R.numrecs(v).first()[0]
    return L.densify(v, [n, 8], L.fill_column("int"), mark=True)


@query(f"SELECT d0, d1, nullif(value, (SELECT min(value) FROM {_CONV})) AS value FROM {_CONV}")
def fill_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _conversations(spark, sf_dir)
    return L.mask_fill(v, F.lit(v.agg(F.min("value")).first()[0]))


@query(f"""SELECT d0, d1, value FROM {_CONV} WHERE d0 <> 3
  UNION ALL SELECT CAST(3 AS BIGINT), CAST(j AS BIGINT), coalesce(c.value, -1) FROM (SELECT unnest(range(8)) AS j) LEFT JOIN {_CONV} c ON c.d0 = 3 AND c.d1 = j""")
def fill_one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fill_record(_conversations(spark, sf_dir), [0, 8], 3, F.lit(-1))


_TILE = """(SELECT row_number() OVER (ORDER BY s0, s1) - 1 AS id, s0, s1, least({h}, r.n - s0) AS c0, least({w}, 100 - s1) AS c1
  FROM (SELECT (count(*) + 99) // 100 AS n FROM orders) r, (SELECT unnest(range(0, (SELECT (count(*) + 99) // 100 FROM orders), {h})) AS s0) a, (SELECT unnest(range(0, 100, {w})) AS s1) b)"""
_MATCH = f"""(SELECT r.id AS r_id, w.id AS w_id, greatest(r.s0, w.s0) AS lo0, greatest(r.s1, w.s1) AS lo1, least(r.s0 + r.c0, w.s0 + w.c0) AS hi0, least(r.s1 + r.c1, w.s1 + w.c1) AS hi1
  FROM {_TILE.format(h=10, w=10)} r JOIN {_TILE.format(h=7, w=11)} w ON r.s0 < w.s0 + w.c0 AND w.s0 < r.s0 + r.c0 AND r.s1 < w.s1 + w.c1 AND w.s1 < r.s1 + r.c1)"""


def _tilings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = _rows(spark, sf_dir)
    return tiles(spark, n, 100, 10, 10), tiles(spark, n, 100, 7, 11)


@query(f"SELECT * FROM {_MATCH}")
def box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writer tiles of 7 x 11 against reader tiles of 10 x 10, clipped in both axes."""
    return B.box_join(*_tilings(spark, sf_dir), 2)


@query(f"SELECT * FROM {_MATCH}")
def box_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through buckets of another width."""
    return B.box_join(*_tilings(spark, sf_dir), 2, width=3)


@query(f"""SELECT r.id, r.c0 * r.c1 AS requested, CAST(coalesce(sum((hi0 - lo0) * (hi1 - lo1)), 0) AS BIGINT) AS matched, coalesce(sum((hi0 - lo0) * (hi1 - lo1)), 0) = r.c0 * r.c1 AS complete
  FROM {_TILE.format(h=10, w=10)} r LEFT JOIN (SELECT * FROM {_MATCH} WHERE w_id % 5 <> 0) m ON m.r_id = r.id GROUP BY r.id, r.c0, r.c1""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads are covered when every fifth write is missing."""
    reads, writes = _tilings(spark, sf_dir)
    return B.coverage(reads, B.box_join(reads, writes.filter("id % 5 <> 0"), 2), 2)


@query(f"SELECT p.k AS point_id, w.id AS box_id FROM (SELECT o_orderkey AS k, o_orderkey // 100 AS d0, o_orderkey % 100 AS d1 FROM orders) p JOIN {_TILE.format(h=7, w=11)} w ON d0 >= s0 AND d0 < s0 + c0 AND d1 >= s1 AND d1 < s1 + c1")
def point_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = orders_grid(spark, sf_dir).select(linear([F.col("d0"), F.col("d1")], [0, 100]).alias("id"), "d0", "d1")
    return B.stab(points, _tilings(spark, sf_dir)[1], 2)


@query(f"""SELECT k % 4 AS owner, count(*) AS n, CAST(sum((least(s0 + c0, (k + 1) * 9) - greatest(s0, k * 9)) * c1) AS BIGINT) AS cells
  FROM (SELECT s0, c0, c1, unnest(range(s0 // 9, (s0 + c0 - 1) // 9 + 1)) AS k FROM {_TILE.format(h=10, w=10)}) GROUP BY 1""")
def owner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = B.split_by_owner(_tilings(spark, sf_dir)[0].withColumn("varid", F.lit(0)), 2, 0, 4, block=9)
    return cut.groupBy("owner").agg(F.count("*").alias("n"), F.sum(B.size(2)).alias("cells"))


_RUN = f"(SELECT id, ((s0 + k) * 100 + s1) * 8 AS \"offset\", c1 * 8 AS len, k * c1 * 8 AS buf FROM (SELECT *, unnest(range(c0)) AS k FROM {_TILE.format(h=7, w=11)}))"


@query(f"SELECT * FROM {_RUN}")
def box_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.runs(_tilings(spark, sf_dir)[1], [0, 100], 8)


@query(f"""SELECT min("offset") AS "offset", max("offset" + len) - min("offset") AS len FROM (
  SELECT *, sum(new) OVER (ORDER BY "offset", len) AS island FROM (
    SELECT *, CASE WHEN "offset" > max("offset" + len) OVER (ORDER BY "offset", len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {_RUN} WHERE id % 3 <> 0)) GROUP BY island""")
def coalesce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coalesce_runs_distributed(B.runs(_tilings(spark, sf_dir)[1].filter("id % 3 <> 0"), [0, 100], 8), 8000)


_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice {d}, l_partkey {d}, l_suppkey {d}, l_quantity {d}, l_discount {d}, l_tax {d}) AS k FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d0"), F.col("l_linenumber").cast("long").alias("d1"), F.col("l_extendedprice").alias("value"), order.alias("seq"))


@query(f"SELECT l_orderkey AS d0, CAST(l_linenumber AS BIGINT) AS d1, l_extendedprice AS value FROM {_LINES.format(d='DESC')} WHERE k = 1")
def overwrite_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resolve(_lines(spark, sf_dir), ["d0", "d1"], "last").select("d0", "d1", "value")


@query(f"SELECT l_orderkey AS d0, CAST(l_linenumber AS BIGINT) AS d1, l_extendedprice AS value FROM {_LINES.format(d='ASC')} WHERE k = 1")
def overwrite_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resolve(_lines(spark, sf_dir), ["d0", "d1"], "first").select("d0", "d1", "value")


@query(f"SELECT d0, CAST(round(sum(CAST(value AS DOUBLE)), 4) AS DOUBLE) AS checksum FROM {_EMB} GROUP BY d0")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.checksum(embeddings(spark, sf_dir), "float", ["d0"]).withColumn("checksum", F.round("checksum", 4))


@query("SELECT event_type, max(event_id) + 1 AS numrecs FROM events GROUP BY event_type")
def numrecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type as a record variable."""
    return R.numrecs(table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("d0")), by=["event_type"])


@query("""SELECT event_type AS component, CAST(round(sum(value), 2) AS DOUBLE) AS total, CAST(round(avg(value), 6) AS DOUBLE) AS mean, CAST(round(stddev_pop(value), 6) AS DOUBLE) AS spread, max(value) AS most
  FROM events GROUP BY event_type""")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("component"), F.col("user_id").alias("rank"), F.col("value").alias("seconds"))
    return R.statistics(log).select("component", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "most")


_DIFF = """(SELECT coalesce(a.o_orderkey, b.o_orderkey) AS d0, a.o_totalprice AS value_a, b.v AS value_b,
  CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b' ELSE 'changed' END AS kind
  FROM (SELECT * FROM orders WHERE o_orderkey % 17 <> 3) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 19 <> 5) b USING (o_orderkey)
  WHERE a.o_totalprice IS DISTINCT FROM b.v)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders_1d(spark, sf_dir)
    changed = o.withColumn("value", F.when(F.col("d0") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return diff_values(o.filter("d0 % 17 <> 3"), changed.filter("d0 % 19 <> 5"), 1)


@query(f"SELECT * FROM {_DIFF}")
def diff_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"SELECT 'orders' AS var, count(*) FILTER (kind = 'changed') AS n_changed, count(*) FILTER (kind = 'only_a') AS n_only_a, count(*) FILTER (kind = 'only_b') AS n_only_b FROM {_DIFF}")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_summary(_diff(spark, sf_dir).withColumn("var", F.lit("orders")))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of 60 events, and reads of 100, of each day's records, a day being an epoch."""
    day = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").cast("long").alias("epoch")).agg(F.min("event_id").alias("lo"), (F.max("event_id") + 1).alias("hi"))

    def boxes(rw: str, n: int) -> DataFrame:
        cut = day.withColumn("s0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi") - F.col("lo") - 1, F.lit(n).cast("long"))))
        rank = F.call_function("div", F.col("s0"), F.lit(n).cast("long"))
        return cut.select(
            F.concat_ws("-", F.lit(rw), "epoch", "s0").alias("req_id"), F.lit("a" if rw == "w" else "b").alias("component"), rank.alias("rank"), F.lit(0).alias("varid"), F.lit(rw).alias("rw"),
            "epoch", F.lit(1).alias("seq"), "s0", F.least(F.lit(n).cast("long"), F.col("hi") - F.col("lo") - F.col("s0")).alias("c0"),
        )

    return boxes("w", 60).unionByName(boxes("r", 100))


_DAY = "(SELECT CAST(day(ts) AS BIGINT) AS epoch, min(event_id) AS lo, max(event_id) + 1 AS hi FROM events GROUP BY 1)"
_BOX = f"(SELECT epoch, s0, least({{n}}, hi - lo - s0) AS c0, '{{rw}}-' || epoch || '-' || s0 AS id FROM (SELECT *, unnest(range(0, hi - lo, {{n}})) AS s0 FROM {_DAY}))"
_PLAN = f"""(SELECT epoch, 0 AS varid, r.id AS r_id, w.id AS w_id, greatest(r.s0, w.s0) AS lo0, least(r.s0 + r.c0, w.s0 + w.c0) AS hi0
  FROM {_BOX.format(n=100, rw='r')} r JOIN {_BOX.format(n=60, rw='w')} w USING (epoch) WHERE r.s0 < w.s0 + w.c0 AND w.s0 < r.s0 + r.c0)"""


@query(f"SELECT * FROM {_PLAN}")
def transfer_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_plan(_requests(spark, sf_dir), 1)


@query(f"SELECT epoch, CAST(sum(hi0 - lo0) AS BIGINT) AS cells, count(*) AS pieces FROM {_PLAN} GROUP BY epoch")
def transfer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.moved_cells(C.match_plan(_requests(spark, sf_dir), 1), 1)


@query(f"""WITH p AS (SELECT * FROM {_PLAN}), q AS (SELECT DISTINCT p.lo0, p.hi0, r.s0 AS rs, r.c0 AS rc, w.s0 AS ws, w.c0 AS wc
    FROM p JOIN {_BOX.format(n=100, rw='r')} r ON r.id = p.r_id JOIN {_BOX.format(n=60, rw='w')} w ON w.id = p.w_id WHERE p.epoch = 1)
  SELECT r.epoch, 0 AS varid, r.id AS r_id, w.id AS w_id, lo0, hi0 FROM q JOIN {_BOX.format(n=100, rw='r')} r ON r.s0 = rs AND r.c0 = rc JOIN {_BOX.format(n=60, rw='w')} w ON w.s0 = ws AND w.c0 = wc AND w.epoch = r.epoch WHERE r.epoch > 1""")
def replay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of day 1, recorded and applied to the other days by equi-joins."""
    log = _requests(spark, sf_dir)
    one = log.filter("epoch = 1")
    return C.replay(C.pattern_of(C.match_plan(one, 1), one, 1), log.filter("epoch > 1"), 1)


_PATTERNS = [("by_net", 0, "example.net", []), ("pages", 1, "http%/en/", ["page=2"]), ("short", 2, "https%example%/de/", [])]


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?s)https.*example.*/de/') THEN 'short' WHEN regexp_matches(url, '(?s)http.*/en/') AND NOT contains(url, 'page=2') THEN 'pages' WHEN contains(url, 'example.net') THEN 'by_net' END AS rule
  FROM pages WHERE regexp_matches(url, '(?s)https.*example.*/de/') OR (regexp_matches(url, '(?s)http.*/en/') AND NOT contains(url, 'page=2')) OR contains(url, 'example.net')""")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_PATTERNS, "rule string, ord int, pattern string, excludes array<string>")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"))
    return pages.join(C.rule_matches(pages.select("name").distinct(), rules), "name").select("page_id", "rule")


def _schema(change: bool = False) -> Schema:
    s = Schema(2)
    s.def_dim("t", 0)
    s.def_dim("y", 4 if not change else 5)
    s.def_dim("x", 3)
    s.def_var("a", "short", ["x"])
    s.def_var("b", "double" if not change else "float", ["y", "x"])
    s.def_var("r", "int", ["t", "x"])
    s.put_att(None, "step", "double", [0.5] if not change else [0.25])
    return s


@query("""SELECT 'dim' AS kind, 'y' AS name, 'NC_EMULTIDEFINE_DIM_SIZE' AS code UNION ALL SELECT 'var', 'b', 'NC_EMULTIDEFINE_VAR_TYPE' UNION ALL SELECT 'attr', 'step', 'NC_EMULTIDEFINE_ATTR_VAL'""")
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency(catalog_frames(spark, _schema()), catalog_frames(spark, _schema(True)))


@query("""WITH v(name, vsize) AS (VALUES ('a', 8), ('b', 96), ('r', 12)), l AS (SELECT name, vsize, 220 + CAST(coalesce(sum(vsize) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin" FROM v)
  SELECT name, "begin", "begin" + vsize AS "end", CAST(vsize AS BIGINT) AS vsize, coalesce("begin" - lag("begin" + vsize) OVER (ORDER BY "begin"), 0) AS gap FROM l""")
def offsets_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout of a file with a declared schema: where variables begin and end, and the gaps between."""
    from gridloom.queries_exchange import scratch
    from gridloom.sources import cdf

    path = f"{scratch(spark)}.nc"
    cdf.write_dataset(Dataset(_schema(), {}), path)
    found = cdf.offsets(spark, path).select("name", "begin", "end", F.col("size").alias("vsize"), "gap")
    cdf.delete(path)
    return found


@query("SELECT event_id, CAST(day(ts) AS BIGINT) AS epoch, value FROM events WHERE day(ts) > 20")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").cast("long").alias("epoch"), "value")
    return drop_late(e, 20)[0]


@query("SELECT epoch, count(*) AS n FROM (SELECT CAST(day(ts) AS BIGINT) AS epoch FROM events WHERE day(ts) <= 20) GROUP BY epoch")
def late_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").cast("long").alias("epoch"))
    return drop_late(e, 20)[1].groupBy("epoch").agg(F.count("*").alias("n"))


@query(f"SELECT d0 - 3 AS d0, d1 - 20 AS d1, value FROM {_GRID} WHERE d0 BETWEEN 3 AND 12 AND d1 BETWEEN 20 AND 59")
def chunk_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of the chunked form."""
    chunks = to_chunks(orders_grid(spark, sf_dir), [_rows(spark, sf_dir), 100], [8, 25])
    return chunk_select(chunks, [3, 20], [10, 40])


@query("SELECT o_orderkey // 250 AS d0, o_orderkey % 250 AS d1, o_totalprice AS value FROM orders")
def reshape_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape(orders_grid(spark, sf_dir), [0, 100], [0, 250])
