"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this process, as in tests; an error on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} intermediate tables need a folder that driver and executors share")
        place = f"file://{tempfile.mkdtemp(prefix='caselens-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/caselens-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, *by: str) -> DataFrame:
    """Write a table to the shared folder (with a folder for each value of ``by``) and read it: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all stashed tables of this application; results that still read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
