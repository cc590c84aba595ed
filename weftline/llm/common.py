"""Session, table and Arrow helpers of the training-data operators."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftline.sources.shared import run_folder, shared_folder

#: Bytes of text that a worker scans at a time; numpy temporaries take 13 to 21 times this, of a longer text alone its bytes so many times.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, computed once, as a compressed table in a folder of its own in the shared one, and that folder, which goes with the process."""
    spark = df.sparkSession
    folder = run_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that written() made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets the cleaner remove shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Size that the optimizer estimates for df, from file sizes; reads no data."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, column: str = "text", most: int = BLOCK_BYTES):
    """Record batches cut at rows so that each holds about `most` bytes of text at the most.

    A longer text comes alone and whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(lengths, dtype=np.int64), 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def column(name: str):
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **columns) -> DataFrame:
    """The rows of docs as one struct, weft_row, beside columns to work on, so that no names clash."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("weft_row"), *(c.alias(n) for n, c in columns.items()))


def filtered(docs: DataFrame, keep, text_column: str = "text", **columns) -> DataFrame:
    """docs, all columns, without the rows for which keep, given record batches of (text, columns), is false."""

    def run(batches):
        for batch in blocks(batches):
            yield batch.filter(pa.array(keep(batch))).select(["weft_row"])

    rows = packed(docs, text=column(text_column), **columns)
    return rows.mapInArrow(run, StructType([StructField("weft_row", docs.schema)])).select("weft_row.*")


#: A key is hot if it holds more than one in so many rows; there are fewer hot keys than that.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on one column; right has each key once at the most, left may hold very many rows of a few.

    Rows of hot keys meet theirs in a broadcast of fewer than HOT rows; the others are shuffled. Both
    sides are read more than once, so they should be written.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("weft_n"))
    hot = cut(counts.where(F.col("weft_n") * HOT > left.count()).select(key))
    mine = right.join(F.broadcast(hot), key, "left_semi")
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right.join(F.broadcast(hot), key, "left_anti"), key)
    return left.join(F.broadcast(mine), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, of edges (a, b).

    Alternates large-star and small-star steps until nothing changes. Only minima are
    grouped, so a node with very many neighbours is never gathered; joins with it are
    skewed joins, which adaptive execution splits. Nulls in edges are not allowed.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now)
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the node's minimum
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: a node's neighbours below it, and itself, go to the least of them
        joined = large.join(low, "a")
        now = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
