"""Transfers as streams: each micro-batch matches what has arrived, and what is not yet covered waits.

Requests (reads and writes with an epoch) arrive as a stream. :func:`stream_transfers` matches them with ``foreachBatch``: reads
that are not covered, and the writes of open epochs, stay in tables under ``state`` until later batches complete them. Each
batch writes its tables under its own number, so a batch that is run again after a failure overwrites its own result only.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.boxes import coverage
from gridloom.plans.couple import announced, match_plan, reads, written_gate
from gridloom.plans.errors import StallError


def drop_late(requests: DataFrame, committed: int) -> tuple[DataFrame, DataFrame]:
    """(current, late): requests of epochs after the last finished one, and those too late."""
    late = F.col("epoch") <= committed
    return requests.filter(~late), requests.filter(late)


def match_pending(pending: DataFrame, ndims: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, coverage, waiting): what can be matched now, and the requests of every epoch that is not complete."""
    plan = match_plan(pending, ndims)
    told = coverage(reads(announced(pending)), plan, ndims)
    open_reads = told.filter("not complete").select(F.col("id").alias("req_id"))
    open_epochs = pending.join(open_reads, "req_id", "left_semi").select("epoch").distinct()
    return plan, told, pending.join(open_epochs, "epoch", "left_semi")


def stream_transfers(
    requests: DataFrame, ndims: int, state: str, checkpoint: str, on_plan: Callable[[DataFrame, int], None] | None = None, available_now: bool = True
) -> StreamingQuery:
    """Starts matching a stream of requests; plans of complete reads go to ``state/plans``, open epochs to ``state/pending``."""
    spark = requests.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        before = _pending(spark, state, number, batch)
        plan, told, waiting = match_pending(announced(batch.unionByName(before)), ndims)
        complete = plan.join(told.filter("complete").select(F.col("id").alias("r_id")), "r_id", "left_semi")
        complete.write.mode("overwrite").parquet(f"{state}/plans/batch={number}")
        waiting.write.mode("overwrite").parquet(f"{state}/pending/{number}")
        if on_plan:
            on_plan(spark.read.parquet(f"{state}/plans/batch={number}"), number)

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _pending(spark: SparkSession, state: str, number: int, like: DataFrame) -> DataFrame:
    """What waited after the batch before this one."""
    if number == 0:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(f"{state}/pending/{number - 1}")


def pending(spark: SparkSession, state: str, number: int) -> DataFrame:
    """Requests still open after a batch, reported when a stream ends instead of waited for."""
    return spark.read.parquet(f"{state}/pending/{number}")


def wait_until(moved: Callable[[], object], done: Callable[[], bool], timeout: float = 180.0, poll: float = 0.5, ignore: bool = False) -> bool:
    """Waits until ``done``; if ``moved`` gives the same for longer than ``timeout``, it stalls: an error, or False with ``ignore``."""
    last, since = moved(), time.monotonic()
    while not done():
        now = moved()
        if now != last:
            last, since = now, time.monotonic()
        elif time.monotonic() - since > timeout:
            if ignore:
                return False
            raise StallError(f"nothing moved for {timeout:g} s")
        time.sleep(poll)
    return True


def await_written(spark: SparkSession, path: str, timeout: float = 180.0, poll: float = 0.5, ignore: bool = False) -> bool:
    """File mode: waits for a writer to finish."""
    return wait_until(lambda: None, lambda: written_gate(spark, path), timeout, poll, ignore)


def await_complete(query: StreamingQuery, state: str, timeout: float = 180.0, poll: float = 0.5, ignore: bool = False) -> bool:
    """Waits until a stream of transfers has no open request left; if it stalls, the stream is stopped."""
    spark, seen = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession(), {"batch": -1, "open": 1}

    def batch() -> int:
        return query.lastProgress["batchId"] if query.lastProgress else -1

    def done() -> bool:
        if (now := batch()) != seen["batch"] and now >= 0 and written_gate(spark, f"{state}/pending/{now}"):
            seen.update(batch=now, open=pending(spark, state, now).count())
        return seen["open"] == 0

    try:
        return wait_until(lambda: (seen["batch"], seen["open"]), done, timeout, poll, ignore)
    except StallError:
        query.stop()
        raise


def record_counts(records: DataFrame, at: str = "ts", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Records and largest record index of each window of a record stream; late ones within ``delay`` still count."""
    return records.withWatermark(at, delay).groupBy(F.window(at, window)).agg(F.count("*").alias("n"), F.max("d0").alias("top"))
