"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the driver ends. Only a local master may leave that unset; then it is a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(root)
    files.deleteOnExit(root)
    return folder
