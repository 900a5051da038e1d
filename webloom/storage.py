"""Tables in the cluster's shared folder, to cut lineage between iterations."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a shuffled part, about.
PART_ROWS = 500_000


def spread(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """`rows` in parts whose number grows with their `size`, so that no task gets more when there are more of them."""
    return rows.repartition(max(1, math.ceil(size / PART_ROWS)), *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines must share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    import tempfile

    base = "file://" + tempfile.mkdtemp(prefix="spark-webloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back; removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
