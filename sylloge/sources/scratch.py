"""Tables that cut lineage: written to the folder all executors share, and read again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop(spark: SparkSession, path: str):
    """(path, file system) of Hadoop's API."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which is deleted when the application ends.

    Where that is unset a local session gets one under the temporary folder; on a cluster it is an error, as executors
    would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "sylloge-scratch")
    found = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    path, fs = hadoop(spark, found)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends at files that outlive executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def delete(df: DataFrame) -> None:
    """Deletes the files of a table that written() returned and that nothing reads any more."""
    path, fs = hadoop(df.sparkSession, df.scratch_path)
    fs.delete(path, True)
