"""Cutting the lineage of bounded driver-side iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """Of this application's tables, in the folder that all executors share (spark.checkpoint.dir; a temporary one only
    where unset)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/cut-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared folder.

    A checkpoint would keep the estimated size of what it was made from. Estimates of joins multiply, so in a loop their
    number of digits doubles with every round, and the driver comes to spend minutes on them. A written table has its
    true size, by which joins are chosen too."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has cut, once its results are written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
