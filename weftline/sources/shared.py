"""The folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.sources import files


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir if the cluster sets it, else, in local sessions only, a temporary folder that goes with the process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what a query writes and reads again; it goes when the process ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_gone, folder)
    return folder


def _gone(folder: str) -> None:
    try:
        files.delete_folder(folder)
    except (OSError, ValueError):
        pass


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, as a table in a folder of its own in the shared one."""
    folder = run_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
