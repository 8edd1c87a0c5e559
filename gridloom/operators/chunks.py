"""Chunked form of dense variables, and variables split over several files along one axis.

A chunk is a row (chunk, s0.., c0.., data): its number along each axis, its box, and its values in row-major order. Its size is bounded by the
chunk's shape, whatever the array's. A box selection first prunes chunks by their edges, which Parquet does from its statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.index import dims, linear, owner_block, unravel


def to_chunks(v: DataFrame, shape: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """A variable in chunks; cells that are missing are null."""
    n = len(shape)
    number = [F.call_function("div", F.col(f"d{i}"), F.lit(c).cast("long")) for i, c in enumerate(chunk)]
    start = [x * c for x, c in zip(number, chunk, strict=True)]
    count = [F.least(F.lit(c).cast("long"), F.lit(m).cast("long") - s) for c, m, s in zip(chunk, shape, start, strict=True)]
    place = F.lit(0).cast("long")
    for i in range(n):
        place = place * count[i] + (F.col(f"d{i}") - start[i])
    cells = v.select(F.array(*number).alias("chunk"), *[x.alias(f"s{i}") for i, x in enumerate(start)], *[x.alias(f"c{i}") for i, x in enumerate(count)], place.alias("p"), "value")
    keys = ["chunk", *[f"{a}{i}" for a in "sc" for i in range(n)]]
    held = cells.groupBy(*keys).agg(F.collect_list(F.struct("p", F.lit(0).alias("blank"), "value")).alias("m"))
    total = reduce(lambda a, b: a * b, [F.col(f"c{i}") for i in range(n)])
    # Sorted by place; where cells are missing, after blanks for every place have been put among them and those not needed left out again.
    kind = held.schema["m"].dataType.elementType["value"].dataType
    blanks = F.transform(F.sequence(F.lit(0).cast("long"), total - 1), lambda p: F.struct(p.alias("p"), F.lit(1).alias("blank"), F.lit(None).cast(kind).alias("value")))
    every = held.select(*keys, F.array_sort(F.when(F.size("m") == total, F.col("m")).otherwise(F.concat("m", blanks))).alias("m"))
    one = F.filter("m", lambda x, i: (i == 0) | (x["p"] != F.get(F.col("m"), i - 1)["p"]))
    return every.select(*keys, F.transform(one, lambda x: x["value"]).alias("data"))


def from_chunks(chunks: DataFrame, ndims: int, keep_missing: bool = False) -> DataFrame:
    """The long form of a chunked variable."""
    cells = chunks.select("*", F.posexplode("data").alias("p", "value"))
    index, rest = [], F.col("p").cast("long")
    for i in reversed(range(ndims)):
        index.insert(0, (F.col(f"s{i}") + F.pmod(rest, F.col(f"c{i}"))).alias(f"d{i}"))
        rest = F.call_function("div", rest, F.col(f"c{i}"))
    out = cells.select(*index, "value")
    return out if keep_missing else out.filter(F.col("value").isNotNull())


def chunk_box(chunks: DataFrame, start: Sequence[int], count: Sequence[int]) -> DataFrame:
    """A box of a chunked variable, in long form and re-based: chunks that miss it are pruned before any is taken apart."""
    n = len(start)
    meets = reduce(lambda a, b: a & b, [(F.col(f"s{i}") < start[i] + count[i]) & (F.col(f"s{i}") + F.col(f"c{i}") > start[i]) for i in range(n)])
    inside = reduce(lambda a, b: a & b, [(F.col(f"d{i}") >= start[i]) & (F.col(f"d{i}") < start[i] + count[i]) for i in range(n)])
    cells = from_chunks(chunks.filter(meets), n).filter(inside)
    return cells.select(*[(F.col(f"d{i}") - start[i]).alias(f"d{i}") for i in range(n)], "value")


def write_subfiles(v: DataFrame, path: str, shape: Sequence[int], axis: int, files: int) -> None:
    """Splits a variable along an axis into ``files`` ranges of equal length, a directory each."""
    part = owner_block(F.col(f"d{axis}"), shape[axis], files)
    v.withColumn("part", part).repartition(files, "part").sortWithinPartitions("part", *dims(len(shape))).write.partitionBy("part").parquet(path)


def read_subfiles(spark: SparkSession, path: str, start: int | None = None, count: int | None = None, length: int = 0, files: int = 1, axis: int = 0) -> DataFrame:
    """A split variable, or its range along the split axis: other directories are not read."""
    v = spark.read.parquet(path)
    if start is not None and count is not None:
        width = -(-length // files)
        v = v.filter(F.col("part").between(start // width, (start + count - 1) // width) & (F.col(f"d{axis}") >= start) & (F.col(f"d{axis}") < start + count))
    return v.drop("part")


def reshape(v: DataFrame, shape: Sequence[int], new_shape: Sequence[int]) -> DataFrame:
    """The same cells in row-major order under another shape."""
    place = linear([F.col(d) for d in dims(len(shape))], shape)
    return v.withColumn("_p", place).select(*[x.alias(f"d{i}") for i, x in enumerate(unravel(F.col("_p"), new_shape))], "value")
