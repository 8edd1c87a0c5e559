"""Reductions: checksums, sizes of requests, numbers of records, statistics over components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.types import TYPES


def checksum(v: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the elements as doubles for floating types, 0 for others."""
    value = F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)) if kind in ("float", "double") else F.sum(F.lit(0.0))
    return v.groupBy(*by).agg(value.alias("checksum"))


def elements(count: Column) -> Column:
    """Elements of a request, the product of its counts array."""
    return F.aggregate(count, F.lit(1).cast("long"), lambda a, x: a * x)


def request_bytes(requests: DataFrame, kind: str) -> DataFrame:
    """Requests with ``n`` elements and their bytes."""
    return requests.withColumn("n", elements(F.col("count"))).withColumn("bytes", F.col("n") * TYPES[kind].size)


def moved(requests: DataFrame) -> DataFrame:
    """Bytes written and read over a log of requests (rw, bytes): one row."""
    return requests.agg(
        F.coalesce(F.sum(F.when(F.col("rw") == "w", F.col("bytes"))), F.lit(0)).alias("put_size"),
        F.coalesce(F.sum(F.when(F.col("rw") == "r", F.col("bytes"))), F.lit(0)).alias("get_size"),
    )


def numrecs(*variables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records over all given record variables, one row (for each ``by``): the largest first index and 1."""
    tops = reduce(lambda a, b: a.unionByName(b), [v.groupBy(*by).agg(F.max("d0").alias("top")) for v in variables])
    return tops.groupBy(*by).agg((F.coalesce(F.max("top"), F.lit(-1)) + 1).cast("long").alias("numrecs"))


def written_records(writes: DataFrame) -> DataFrame:
    """Records after writes (s0, c0, t0)."""
    return writes.agg(F.coalesce(F.max(F.when(F.col("c0") > 0, F.col("s0") + (F.col("c0") - 1) * F.col("t0") + 1)), F.lit(0)).cast("long").alias("numrecs"))


def statistics(log: DataFrame, value: str = "seconds", place: str = "rank", by: Sequence[str] = ("component",)) -> DataFrame:
    """Sum, mean, population deviation and largest value, with its place, of each group."""
    x = F.col(value)
    return log.groupBy(*by).agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("spread"), F.max(x).alias("most"), F.max_by(place, x).alias("most_at"))


def done(log: DataFrame, by: Sequence[str] = ("group",)) -> DataFrame:
    """(n, n_done, all_done) of each group of a log with the column ``done``."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("done").alias("n_done"), F.bool_and("done").alias("all_done"))
