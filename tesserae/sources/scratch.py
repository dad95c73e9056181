"""Tables written to the folder that the cluster shares, in place of recomputing them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(top)
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/tesserae/{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_later(spark: SparkSession) -> None:
    """This application's folder goes when the driver ends."""
    top, files = _folder(spark)
    files.deleteOnExit(top)


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a table in the shared folder: lineage ends there, and a lost executor costs no recomputation.

    The folder goes when the driver ends, or with clear().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_later(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop(*kept: DataFrame) -> None:
    """Deletes the tables that these results of keep() read, once nothing reads them any more."""
    for df in kept:
        spark = df.sparkSession
        top, files = _folder(spark)
        inside = top.toUri().getPath()
        for name in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.getParent().toUri().getPath() != inside:
                raise ValueError(f"{path} is no kept table")
            files.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that keep() has written in this application."""
    path, files = _folder(spark)
    files.delete(path, True)
