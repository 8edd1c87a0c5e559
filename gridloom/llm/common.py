"""Helpers shared by the text operators."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

#: White space of every contract here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone is one set here; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            where = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            where = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
            spark.sparkContext.setCheckpointDir(where)
    return where


#: Has Spark drop an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder: lineage ends there, and a lost executor costs nothing.

    Parquet is compressed and read by column, which checkpoint files are not. Shuffle files of the computation go when it is
    done, the table when it is discarded or the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    fs, at = _at(out)
    fs.deleteOnExit(at)
    return out


def _at(df: DataFrame) -> tuple:
    """The file system and path of a settled table."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_at)
    return at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), at


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        fs, at = _at(df)
        fs.delete(at, True)


#: Rows in a batch for Python: texts are long rows, and a batch is held several times over.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches that bound a worker's memory, unless the session has chosen a size of its own."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == "10000":  # Spark's own
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The running result of ``op`` over an array, each element included.

    An array that grows by one is copied each time, so results are built in blocks of as many elements as there are blocks:
    n elements cost n times the root of n copied numbers, not n squared.
    """

    def within(block: Column) -> Column:
        step = lambda acc, x: let(op(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))
        return F.aggregate(block, F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out")), step, lambda acc: acc["out"])

    def cut(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, w).cast("int")), lambda k: within(F.slice(v, k * w + 1, w))))

    def joined(blocks: Column) -> Column:
        tops = within(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda b, k: F.when(k == 0, b).otherwise(let(F.get(t, k - 1), lambda c: F.transform(b, lambda x: op(c, x)))))))

    return F.when(F.size(values) > 0, let(values, lambda v: let(cut(v), joined))).otherwise(F.slice(F.array(zero), 1, 0))


def words(text: Column) -> Column:
    """The words of a text, maximal runs without white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is.

    ``lower`` has a fast path for ASCII; it is also right where no character outside ASCII has a lower case.
    ``translate``, several times slower, handles what is left.
    """
    other_case = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"
    return (
        F.when(F.length(text) == F.octet_length(text), F.lower(text))
        .when(~text.rlike(other_case), F.lower(text))
        .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    )


def range_rank(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` with its 0-based global rank, by a range sort and one offset per partition; no single-task sort."""
    pos = F.col("_mid")
    placed = settled(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))  # places are fixed from here on
    per = placed.groupBy(F.shiftright(pos, 33).alias("_pid")).agg(F.count("*").alias("_n"))
    # One row for each partition of the sort: bounded by the number of partitions, whatever the input.
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.withColumn("_pid", F.shiftright(pos, 33))
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + pos.bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_pid", "_mid", "_off")
    )
