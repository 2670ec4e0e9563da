"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in ``spark.checkpoint.dir``, or in our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:  # on one machine any folder is shared
        found = "file:///tmp/checkpoints/sitecast" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/sitecast_scratch"
    return f"{found}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: iterations stand on files, not on what led to them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a ``kept`` table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
