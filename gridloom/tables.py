"""Array views of relational tables, and the data sets that the queries are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.index import unravel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 2-D float variable (vec_id, k)."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "value")).withColumn("d1", F.col("d1").cast("long"))


def orders_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("value"))


def orders_grid(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """Dense 2-D variable: key div width, key mod width."""
    o = orders_1d(spark, sf_dir)
    i, j = unravel(F.col("d0"), [0, width])
    return o.select(i.alias("d0"), j.alias("d1"), "value")


def tiles(spark: SparkSession, rows: int, columns: int, height: int, width: int) -> DataFrame:
    """Boxes (id, s0, s1, c0, c1) that tile a grid, the last ones cut at its edges."""
    across = -(-columns // width)
    n = -(-rows // height) * across
    i, j = unravel(F.col("id"), [0, across])
    boxes = spark.range(n).select("id", (i * height).alias("s0"), (j * width).alias("s1"))
    return boxes.withColumns({"c0": F.least(F.lit(height).cast("long"), F.lit(rows) - F.col("s0")), "c1": F.least(F.lit(width).cast("long"), F.lit(columns) - F.col("s1"))})
