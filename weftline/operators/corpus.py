"""Corpus preparation: cleaning, length filter, statistics, histogram and split."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from weftline.functions import text as T
from weftline.functions.columns import fixed
from weftline.sources import export
from weftline.sources.records import read_open
from weftline.sources.numbers import numbered

__all__ = ["clean", "clean_nested", "clean_open", "exact_split", "filter_max_words", "hash_split", "merge_files", "numbered", "token_chart", "token_histogram", "token_stats", "word_counts"]

MAX_WORDS = 500
BINS = 50
TRAIN_SHARE, SEED = 0.8, 42
#: Rows that the exact shuffle may permute, in 800 MB of one task.
EXACT_ROWS = 100_000_000


def clean(records: DataFrame, column: str = "paragraph") -> DataFrame:
    return records.withColumn(column, F.expr(T.clean_text(column)))


def _cleaned(x: str, kind: DataType, key: str, named: bool = False) -> str:
    """x with every text under the key cleaned, at any depth; what else stands under the key stays as it is."""
    if named:
        return T.clean_text(x) if isinstance(kind, StringType) else x
    n = x.count("->")  # lambdas within lambdas need names of their own
    if isinstance(kind, StructType):
        fields = ", ".join(f"'{f.name}', {_cleaned(f'{x}.`{f.name}`', f.dataType, key, f.name == key)}" for f in kind.fields)
        return f"if({x} is null, null, named_struct({fields}))"
    if isinstance(kind, ArrayType):
        name = f"a{len(x)}_{n}"
        return f"transform({x}, {name} -> {_cleaned(name, kind.elementType, key)})"
    if isinstance(kind, MapType):
        k, v = f"k{len(x)}_{n}", f"v{len(x)}_{n}"
        return f"transform_values({x}, ({k}, {v}) -> if({k} = '{key}', {_cleaned(v, kind.valueType, key, True)}, {_cleaned(v, kind.valueType, key)}))"
    return x


def clean_nested(records: DataFrame, key: str = "paragraph") -> DataFrame:
    """records with the texts of every column and nested field or map key of that name cleaned, whatever the depth."""
    return records.select(*(F.expr(_cleaned(f"`{f.name}`", f.dataType, key, f.name == key)).alias(f.name) for f in records.schema.fields))


def filter_max_words(records: DataFrame, most: int = MAX_WORDS, column: str = "paragraph", count: str | None = None) -> DataFrame:
    """records of so many words at the most; count names a column that keeps their number. Words are split once."""
    kept = fixed(records, **{count or "weft_words": T.word_count(column)}).where(F.col(count or "weft_words") <= most)
    return kept if count else kept.drop("weft_words")


def word_counts(records: DataFrame, column: str = "paragraph") -> DataFrame:
    """(n, records): how many records have so many words. All statistics follow from it, and it is as long as word counts differ."""
    return records.select(F.expr(T.word_count(column)).cast("bigint").alias("n")).groupBy("n").agg(F.count("*").alias("records")).where("n is not null")


def token_stats(records: DataFrame, column: str = "paragraph") -> DataFrame:
    """One row, of one pass over the texts; sums are whole numbers, so that nothing is lost however many records there are."""
    total = lambda x: F.expr(f"sum(cast({x} as decimal(38, 0)))")
    sums = word_counts(records, column).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"), total("n * records").alias("s"), total("n * n * records").alias("q"), F.expr("percentile(n, 0.5D, records)").alias("median"), F.min("n").alias("min"), F.max("n").alias("max")
    )
    mean, deviation = "cast(s as double) / records", "sqrt(cast(records * q - s * s as double)) / records"
    empty = lambda x: F.expr(f"if(records = 0, null, {x})")
    return sums.select("records", empty(mean).alias("mean"), "median", empty(deviation).alias("std"), "min", "max")


def token_histogram(records: DataFrame, bins: int = BINS, column: str = "paragraph") -> DataFrame:
    """(bin, low, high, records) for every bin, numbered from 1; the last is closed, and one value alone gets bins around it.

    One pass over the texts; the table of word counts, as long as they differ, comes together in a row.
    """
    row = word_counts(records, column).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.collect_list(F.struct("n", "records")).alias("counts")).where("least is not null")
    row = fixed(row, lo="if(least = most, least - 0.5D, cast(least as double))", hi="if(least = most, most + 0.5D, cast(most as double))")
    row = fixed(row, placed=f"transform(counts, c -> named_struct('bin', cast(least(width_bucket(c.n, lo, hi, {bins}), {bins}) as int), 'records', c.records))")
    every = row.select("lo", "hi", "placed", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    found = "aggregate(filter(placed, p -> p.bin = bin), 0L, (a, p) -> a + p.records)"
    return every.select("bin", F.expr(f"lo + (hi - lo) * (bin - 1) / {bins}").alias("low"), F.expr(f"lo + (hi - lo) * bin / {bins}").alias("high"), F.expr(found).alias("records"))


# The chart's texts.
CHART_TITLE, CHART_X, CHART_Y = "Token distribution per procedure", "Token count (words)", "Frequency"
#: Pixels of the chart, and of its plot within.
CHART, PLOT = (800, 500), (60, 40, 700, 400)


def token_chart(records: DataFrame, bins: int = BINS, column: str = "paragraph") -> DataFrame:
    """(svg): the histogram drawn as one SVG text, with lines at mean and median; no row without records.

    Drawn from the table of word counts alone, in one row; write it with files.write() or as text.
    """
    left, top, width, height = PLOT
    row = token_histogram(records, bins, column).agg(F.array_sort(F.collect_list(F.struct("bin", "records"))).alias("bars"), F.max("records").alias("highest"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    # one row each
    row = row.join(F.broadcast(token_stats(records, column).select("mean", "median", "min", "max"))).where("highest > 0")
    y = lambda n: f"cast(floor({height} * {n} / highest) as bigint)"
    bar = f"""concat('<rect x="', {left} + (b.bin - 1) * {width} div {bins}, '" y="', {top + height} - {y('b.records')}, '" width="', b.bin * {width} div {bins} - (b.bin - 1) * {width} div {bins}, '" height="', {y('b.records')}, '" fill="steelblue"/>')"""
    at = lambda v: f"cast(floor({left} + {width} * ({v} - lo) / (hi - lo)) as bigint)"

    def line(value, label, colour, place):
        label = f"concat('{label}: ', cast(round({value}) as bigint))"
        return f"""concat('<line x1="', {at(value)}, '" x2="', {at(value)}, '" y1="{top}" y2="{top + height}" stroke="{colour}" stroke-dasharray="6 4"/><text x="{left + width - 120}" y="{top + place}" fill="{colour}">', {label}, '</text>')"""

    text = lambda x, y, t, more="": f"""'<text x="{x}" y="{y}" text-anchor="middle"{more}>{t}</text>'"""
    parts = [
        f"""'<svg xmlns="http://www.w3.org/2000/svg" width="{CHART[0]}" height="{CHART[1]}" font-family="sans-serif" font-size="14">'""",
        text(left + width // 2, top - 15, CHART_TITLE),
        f"array_join(transform(filter(bars, b -> b.records > 0), b -> {bar}), '')",
        f"""'<path d="M{left} {top}V{top + height}H{left + width}" fill="none" stroke="black"/>'""",
        line("mean", "Mean", "red", 20),
        line("median", "Median", "orange", 40),
        text(left + width // 2, CHART[1] - 15, CHART_X),
        text(15, top + height // 2, CHART_Y, f' transform="rotate(-90 15 {top + height // 2})"'),
        f"""concat('<text x="{left}" y="{top + height + 20}">', cast(min as string), '</text><text x="{left + width}" y="{top + height + 20}" text-anchor="end">', cast(max as string), '</text><text x="{left - 5}" y="{top + 12}" text-anchor="end">', cast(highest as string), '</text>')""",
        "'</svg>'",
    ]
    return row.select(F.expr(f"concat({', '.join(parts)})").alias("svg"))


def clean_open(records: DataFrame, key: str = "paragraph") -> DataFrame:
    """Open records (a column record of VARIANT values) with every string under the key cleaned, at any depth; all else stays."""
    return records.withColumn("record", F.parse_json(F.expr(T.clean_json("to_json(record)", key))))


def merge_files(spark: SparkSession, paths: list[str], out: str, most: int = MAX_WORDS, indent: int | None = 2) -> dict[str, int]:
    """The array files one after another as one, cleaned, with all keys, without records of more words.

    Returns before, after and removed, counted by the write itself. No record passes through the driver and none is
    sorted: tasks write what they read, in order.
    """
    rows = None
    for path in paths:
        part = clean_open(read_open(spark, path))
        rows = part if rows is None else rows.unionByName(part)
    words = fixed(rows, weft_words=T.word_count("coalesce(try_variant_get(record, '$.paragraph', 'string'), '')"))
    counted = Observation()
    kept = words.observe(counted, F.count("*").alias("before"), F.count_if(F.col("weft_words") <= most).alias("after")).where(F.col("weft_words") <= most)
    export.write_array(export.open_json(kept, ascii_only=True, indent=indent), out, None, indent)
    found = counted.get
    return {"before": found["before"], "after": found["after"], "removed": found["before"] - found["after"]}


def exact_split(records: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """records with position and split after Python's seeded shuffle of their numbers.

    record_no must be dense from 0. The shuffle draws each number from the state that the one before left,
    so one task makes it, in eight bytes for each row, for up to EXACT_ROWS rows; records themselves stay
    distributed.
    """
    n = records.count()
    if n > EXACT_ROWS:
        raise ValueError(f"{n} rows; the exact shuffle is for {EXACT_ROWS} at the most, hash_split() for any number")

    def shuffled(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                order = array("q", range(n))
                random.Random(seed).shuffle(order)
                drawn = np.frombuffer(order, np.int64)
                for begin in range(0, n, 1 << 16):
                    part = drawn[begin : begin + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(begin, begin + len(part)))], ["record_no", "position"])

    rows = records.sparkSession.range(0, 1, 1, 1).mapInArrow(shuffled, "record_no bigint, position bigint")
    return records.join(rows, "record_no").withColumn("split", F.when(F.col("position") < int(n * share), "train").otherwise("test"))


def hash_split(records: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED, key: str = "record_no") -> DataFrame:
    """records with split: the first int(n * share) by hash of the key, exactly, without sorting the whole.

    Rows are counted in 65,536 buckets of the hash; only the bucket that the cut falls into is ranked.
    """
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))
    rows = records.withColumn("weft_hash", h).withColumn("weft_bucket", F.substring("weft_hash", 1, 4))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("weft_bucket").count().collect())
    left, cut = int(sum(c for _, c in counts) * share), None
    for bucket, c in counts:
        if left < c:
            cut = bucket
            break
        left -= c
    inside = rows.where(F.col("weft_bucket") == F.lit(cut)).withColumn("weft_rank", F.expr(f"row_number() over (partition by weft_bucket order by weft_hash, {key})"))
    outside = rows.where(F.coalesce(F.col("weft_bucket") != F.lit(cut), F.lit(True))).withColumn("weft_rank", F.when(F.lit(cut).isNull() | (F.col("weft_bucket") < F.lit(cut)), 0).otherwise(left + 1))
    return inside.unionByName(outside).withColumn("split", F.when(F.col("weft_rank") <= left, "train").otherwise("test")).drop("weft_hash", "weft_bucket", "weft_rank")
