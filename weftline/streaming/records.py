"""Extraction over a stream of record files: records are independent, so the batch operators apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.graph import graphs
from weftline.operators.workflow import workflows
from weftline.sources.records import RAW


def stream_workflows(spark: SparkSession, folder: str) -> DataFrame:
    """Workflows, without states, of JSON Lines files as they arrive; record_no is the file_index."""
    raw = spark.readStream.schema(RAW).option("mode", "FAILFAST").json(folder)
    return workflows(graphs(raw.withColumn("record_no", F.col("file_index"))))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived, exactly once, and stops."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
