"""Documents from raw to token ids: five stages, each of which reads what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it again as the next stage's docs. Stages keep the columns of documents; the
last returns doc_id, n_tokens, ids_sha256, decoded_sha256. A stage that needs labels or the benchmark
reads them from sf_dir. Documents in and models out: classifiers are fitted on a bounded sample of
the documents that reach their stage. Null texts, ids and metadata, empty tables, repeated rows and ids and
further columns are treated as the operators' docstrings say: no row is lost but to a stage's verdict, and
the near-copy stage keeps one row of each group, told by id and text. A stage's table is deleted
when the next one is written, the last one with the process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, quality, sentencepiece, simhash, toxicity
from weftline.llm.common import delete, run_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The classifiers and SentencePiece are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number:
                delete(spark, f"{folder}/{number - 1}")
    return docs
