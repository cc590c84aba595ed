"""Dense numbers in order, made by many tasks."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import shared_folder


def numbered(rows: DataFrame, *order: str, name: str = "record_no") -> DataFrame:
    """rows with dense numbers from 0 in order, which no task and no driver has to see whole.

    Ranges of the order go to tasks, which count their rows; the driver adds the counts up. The order is kept in the
    shared folder, so that it is the same when it is counted and when it is read. Rows of equal order come in any.
    """
    shared_folder(rows.sparkSession)
    ordered = rows.orderBy(*order).withColumn("weft_task", F.spark_partition_id()).withColumn("weft_at", F.monotonically_increasing_id() - F.col("weft_task").cast("bigint") * (1 << 33)).checkpoint()
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy("weft_task").count().collect())
    begins = dict(zip([t for t, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False))
    # a row for each task
    offsets = rows.sparkSession.createDataFrame(list(begins.items()), "weft_task int, weft_begin bigint")
    return ordered.join(F.broadcast(offsets), "weft_task").withColumn(name, F.col("weft_begin") + F.col("weft_at")).drop("weft_task", "weft_at", "weft_begin")
