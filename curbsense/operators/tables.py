"""Tables written on the way, so that a loop's lineage stays short and a lost executor costs little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, which all executors share, and read back; its path is added to `made`."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, made: list[str]) -> None:
    """Delete tables that cut() has written for one call, once its result is written."""
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the number (from 1) of each row in order of a unique key, counted range by range, so no task orders all rows."""
    ranged = cut(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # One row a partition.
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("range").orderBy(key))
    rows = ranged.withColumn("rank", rank).join(sizes.select("range", before.alias("before")), "range")
    return rows.withColumn(name, (F.col("before") + F.col("rank")).cast("int")).drop("range", "rank", "before")
