"""Folders for data in between, which the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the folder set on its context. Where neither is set, one of this machine's in local mode, where all executors are in one process; an error anywhere else."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if given:
        return given
    if context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'plinth-checkpoints')}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and file system of a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession) -> str:
    """The path of a folder that goes, at the latest, when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/plinth-{uuid.uuid4().hex}"
    where, system = file_system(spark, path)
    system.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where, system = file_system(spark, path)
    system.delete(where, True)
