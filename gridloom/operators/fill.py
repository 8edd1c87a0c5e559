"""Fill values: dense arrays from sparse ones, records filled by number, and missing data masked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.index import dims, unravel
from gridloom.functions.types import TYPES
from gridloom.plans.errors import ArrayError


def fill_value(kind: str, attribute: tuple[str, Sequence] | None = None):
    """The fill of a variable: its attribute (type, values) if there is one of its type and one value, else the type's default."""
    if attribute is None:
        return TYPES[kind].fill
    held, values = attribute
    if held != kind or len(values) != 1:
        raise ArrayError("NC_EBADTYPE")
    return values[0]


def fill_column(kind: str, value=None) -> Column:
    x = TYPES[kind].fill if value is None else value
    return F.lit(str(x) if kind == "uint64" else x).cast(TYPES[kind].spark)


def grid(spark, shape: Sequence[int], start: Sequence[int] | None = None) -> DataFrame:
    """Every index of a box. Places are dealt over the cluster by ``range``; only arithmetic follows."""
    total = 1
    for n in shape:
        total *= n
    index = unravel(F.col("id"), shape)
    return spark.range(total).select(*[(x + (start[i] if start else 0)).alias(f"d{i}") for i, x in enumerate(index)])


def densify(v: DataFrame, shape: Sequence[int], fill: Column, start: Sequence[int] | None = None, mark: bool = False) -> DataFrame:
    """A value at every index; where ``v`` has none, ``fill``. With ``mark``, ``is_fill`` tells which."""
    if not len(shape):
        return v.select(F.coalesce("value", fill).alias("value"), *[F.col("value").isNull().alias("is_fill")] * mark)
    keys = dims(len(shape))
    cells = v.select(*keys, F.col("value").alias("_value"), F.lit(True).alias("_there"))
    full = grid(v.sparkSession, shape, start).join(cells, keys, "left")
    missing = F.col("_there").isNull() | F.col("_value").isNull()
    out = full.select(*keys, F.when(missing, fill).otherwise(F.col("_value")).alias("value"), missing.alias("is_fill"))
    return out if mark else out.drop("is_fill")


def fill_record(v: DataFrame, shape: Sequence[int], record: int, fill: Column, *, is_record: bool = True, fill_on: bool = True) -> DataFrame:
    """A record variable with every missing element of one record filled; ``shape[0]`` is not used."""
    if not is_record:
        raise ArrayError("NC_ENOTRECVAR")
    if not fill_on:
        raise ArrayError("NC_ENOTFILL")
    one = densify(v.filter(F.col("d0") == record), [1, *shape[1:]], fill, [record, *[0] * (len(shape) - 1)])
    return v.filter(F.col("d0") != record).select(*one.columns).unionByName(one)


def fill_records(v: DataFrame, shape: Sequence[int], numrecs: int, fill: Column) -> DataFrame:
    """A record variable filled up to ``numrecs``, as one added to a dataset that has records already."""
    return densify(v, [numrecs, *shape[1:]], fill)


def mask_fill(v: DataFrame, fill: Column) -> DataFrame:
    """Fill values as nulls; the only place where one becomes the other."""
    return v.withColumn("value", F.when(F.col("value") != fill, F.col("value")))
