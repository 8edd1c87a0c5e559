from pyspark.sql import functions as F

from gridloom.operators import chunks as K
from gridloom.operators import fill as L
from gridloom.operators.diff import diff_values
from gridloom.operators.select import vara

SHAPE = [7, 9]


def test_chunked_form_equals_long_form(spark, tmp_path):
    v = L.grid(spark, SHAPE).withColumn("value", F.col("d0") * 9 + F.col("d1")).filter("value % 11 <> 3")
    K.to_chunks(v, SHAPE, [3, 4]).write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    assert chunks.count() == 9
    assert diff_values(v, K.from_chunks(chunks, 2), 2).count() == 0
    assert diff_values(vara(v, [2, 3], [3, 5]), K.chunk_box(chunks, [2, 3], [3, 5]), 2).count() == 0
    plan = K.chunk_box(chunks, [2, 3], [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThan(s0,5)" in plan


def test_split_files(spark, tmp_path):
    v = L.grid(spark, SHAPE).withColumn("value", F.col("d0") * 9 + F.col("d1"))
    K.write_subfiles(v, str(tmp_path / "s"), SHAPE, 1, 3)
    assert diff_values(v, K.read_subfiles(spark, str(tmp_path / "s")), 2).count() == 0
    part = K.read_subfiles(spark, str(tmp_path / "s"), 2, 3, 9, 3, 1)
    assert diff_values(v.filter("d1 between 2 and 4"), part, 2).count() == 0
    assert "PartitionFilters: [isnotnull(part" in part._jdf.queryExecution().executedPlan().toString()


def test_reshape(spark):
    v = L.grid(spark, [4, 6]).withColumn("value", F.col("d0") * 6 + F.col("d1"))
    out = K.reshape(v, [4, 6], [2, 3, 4])
    assert out.filter("value <> (d0 * 3 + d1) * 4 + d2").count() == 0 and out.count() == 24
