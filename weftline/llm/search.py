"""Ranked lexical search over an index of postings.

The index is a table of segments, each of some documents of one task: its terms, and for each the
documents that hold it, in ascending order of their ids, as differences and frequencies in as few bytes
as they need. A search reads each segment document at a time: the lists of a query's terms are merged
by a heap of their next documents, and a bounded heap, whose least entry is the one of lowest score and
then highest id, keeps the best. It lives as long as the task, so that later segments start with
its bound: lists that cannot lift a document over it, even all together, leave the merge and are only
looked up for documents that others name. Tasks return their best, which meet in one ranking.

Building shuffles nothing. A search reads the index twice: once for the terms' document frequencies, once
for the scores.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.llm import words
from weftline.llm.common import blocks, column, plain, table, written
from weftline.llm.packing import packed_numbers, unpacked_numbers

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Results of a query.
BEST = 10
#: Bytes of text scanned at a time, and those at whose reaching a segment ends.
BLOCK, SEGMENT = 2 << 20, 16 << 20
#: Bytes of queries that are answered in one go, and so sent to every task.
QUERY_BYTES = 1 << 20
#: Sorts before all ids.
NO_ID = -(1 << 63) - 1

# building


class _Segment:
    """What a segment gathers of its documents."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids: list = []
        self.lengths: list = []
        self.parts: list = []
        self.documents = self.bytes = 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        first, hashed, starts, ends = words.scan(data, offsets, "letters")
        low, sizes = words.lowered(data), ends - starts
        _, at, which = np.unique(hashed, return_index=True, return_inverse=True)
        # a hash that two terms share: those that differ from the first stand for themselves
        odd = np.flatnonzero(~(words.equal(low, starts, low, starts[at][which], sizes) & (sizes == sizes[at][which])))
        which[odd] = len(at) + np.arange(len(odd))
        at = np.concatenate((at, odd))
        raw, numbers = low.tobytes(), self.numbers
        term = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], np.int64)
        document = self.documents + np.repeat(np.arange(len(ids)), np.diff(first))
        pairs, times = np.unique(document << 32 | term[which], return_counts=True)
        self.parts.append((pairs, times))
        self.ids.append(ids)
        self.lengths.append(np.diff(first))
        self.documents += len(ids)
        self.bytes += len(data)

    def row(self) -> list:
        ids = pa.concat_arrays(self.ids)
        null = np.asarray(ids.is_null())
        numbers = ids.fill_null(0).to_numpy()
        order = np.lexsort((numbers, ~null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.concatenate(self.lengths)[order]
        pairs, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys = (pairs & 0xFFFFFFFF) << 32 | place[pairs >> 32]
        order_of = np.argsort(keys)
        keys, times = keys[order_of], times[order_of]
        term, document = keys >> 32, keys & 0xFFFFFFFF
        counts = np.bincount(term, minlength=len(self.numbers))
        steps = np.diff(document, prepend=0)
        begins = np.cumsum(counts) - counts
        steps[begins] = document[begins]
        data, ends = packed_numbers(np.stack((steps, times), 1).ravel())
        sizes = np.diff(np.concatenate(([0], ends[2 * (begins + counts) - 1]))) if len(counts) else np.zeros(0, np.int64)
        packed = lambda x: packed_numbers(x)[0].tobytes()
        return [len(order), int((lengths > 0).sum()), int(lengths.sum()), int(null.sum()), numbers[order].astype("<i8").tobytes(), packed(lengths), b"\n".join(self.numbers), packed(counts), packed(sizes), data.tobytes()]


SEGMENT_COLUMNS = "documents bigint, with_terms bigint, all_terms bigint, nulls bigint, doc_ids binary, lengths binary, terms binary, frequencies binary, sizes binary, postings binary"
_TYPES = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.binary()) for c in SEGMENT_COLUMNS.split(", ")])


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The segments of all documents. Null and empty texts have no terms; null ids stay; every row is a document."""

    def run(batches):
        now = _Segment()
        for batch in blocks(batches, "text", BLOCK):
            now.add(batch.column("doc_id"), *plain(batch.column("text")))
            if now.bytes >= segment:
                yield pa.RecordBatch.from_pylist([dict(zip(_TYPES.names, now.row(), strict=True))], _TYPES)
                now = _Segment()
        if now.documents:
            yield pa.RecordBatch.from_pylist([dict(zip(_TYPES.names, now.row(), strict=True))], _TYPES)

    return docs.select(column(id_column).cast("bigint").alias("doc_id"), column(text_column).cast("string").alias("text")).mapInArrow(run, SEGMENT_COLUMNS)


# searching


def _numbers(data: bytes) -> np.ndarray:
    return unpacked_numbers(np.frombuffer(data, np.uint8))


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def _sizes(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term's frequency is set against in each document: a quarter fixed, the rest by its length."""
    if 75 * int(lengths.max(initial=0)) * documents < 1 << 63:
        return 25 + 75 * lengths * documents // terms
    return np.array([25 + 75 * n * documents // terms for n in lengths.tolist()], np.int64)


class _List:
    """A term's documents in a segment, by place, and what it adds to their scores."""

    def __init__(self, documents: list[int], gains: list[int]):
        self.documents, self.gains, self.most = documents, gains, max(gains)


def _lists(row: dict, wanted: dict[bytes, int], weights: list[int], documents: int, terms: int) -> dict[int, _List]:
    """The lists of wanted terms that a segment has, by their numbers."""
    held = [(i, wanted[t]) for i, t in enumerate(row["terms"].split(b"\n")) if t in wanted]
    if not held or not row["frequencies"]:
        return {}
    ends = np.cumsum(_numbers(row["sizes"]))
    sizes = _sizes(_numbers(row["lengths"]), documents, terms)
    out = {}
    for i, number in held:
        if weights[number] <= 0:
            continue
        values = _numbers(row["postings"][int(ends[i - 1]) if i else 0 : int(ends[i])])
        places, times = np.cumsum(values[0::2]), values[1::2]
        gains = weights[number] * (1_000_000_000 * times // (1000 * times + 8 * sizes[places]))
        out[number] = _List(places.tolist(), gains.tolist())
    return out


def _rank(lists: list[tuple[_List, int]], ids: list, best: list, k: int) -> None:
    """Merges a query's lists, each with its number of occurrences in the query, into its k best (score, -id, place) so far."""
    lists = sorted(((x, n) for x, n in lists), key=lambda p: p[0].most * p[1])
    most = [x.most * n for x, n in lists]
    # what the lists before each could add at the most
    below = [0, *itertools.accumulate(most)]
    bound = best[0][0] if len(best) == k else 1
    if below[-1] < bound:
        return
    at = [0] * len(lists)
    first = 0
    while below[first + 1] < bound:
        first += 1
    merge = [(x.documents[0], i) for i, (x, _) in enumerate(lists) if i >= first]
    heapq.heapify(merge)
    while merge:
        document, score = merge[0][0], 0
        while merge and merge[0][0] == document:
            i = merge[0][1]
            x, n = lists[i]
            j = at[i]
            score += x.gains[j] * n
            at[i] = j = j + 1
            if j < len(x.documents):
                heapq.heapreplace(merge, (x.documents[j], i))
            else:
                heapq.heappop(merge)
        for i in range(first - 1, -1, -1):
            if score + below[i + 1] < bound:
                break
            x, n = lists[i]
            at[i] = j = bisect_left(x.documents, document, at[i])
            if j < len(x.documents) and x.documents[j] == document:
                score += x.gains[j] * n
        if score < bound:
            continue
        entry = (score, -ids[document])
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == k and best[0][0] > bound:
            bound = best[0][0]
            before = first
            while first < len(lists) and below[first + 1] < bound:
                first += 1
            if first > before:
                merge = [(d, i) for d, i in merge if i >= first]
                heapq.heapify(merge)


def query_terms(text: str | None) -> Counter:
    """A query's terms, with their occurrences."""
    return Counter(TERM.findall((text or "").encode().lower()))


def _blocks(queries: DataFrame, most: int):
    """Queries in runs of so many bytes of text, each run a list of (number, id, terms)."""
    held, size = [], 0
    for number, row in enumerate(queries.toLocalIterator()):
        held.append((number, row[0], query_terms(row[1])))
        size += len(row[1] or "") + 100
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(segments: DataFrame, queries: DataFrame, k: int = BEST, id_column: str = "item_id", text_column: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(id, rank, doc_id, score): the k documents of highest score above 0 of each query, equal scores by ascending id.

    Every row of queries is a query, also where ids repeat or are null; those without terms, null or
    empty, have no results. Documents with null ids come before others of their score, and an id that
    several documents share may come as often. An empty index or table of queries gives an empty result.
    segments should be written, as they are read twice for each block of queries.
    """
    spark = segments.sparkSession
    kind = queries.schema[id_column].dataType
    total = segments.agg(F.sum("with_terms").alias("n"), F.sum("all_terms").alias("l")).first()
    documents, terms = total["n"] or 0, total["l"] or 0
    found = None
    for run in _blocks(queries.select(column(id_column), column(text_column)), query_bytes) if terms else ():
        ranked = _search(segments, run, documents, terms, k)
        names = spark.createDataFrame([(n, i) for n, i, _ in run], f"number bigint, id {kind.simpleString()}")
        # a row for each query of the block
        part = ranked.join(F.broadcast(names), "number").select(F.col("id").alias(id_column), "rank", "doc_id", "score")
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], f"`{id_column}` {kind.simpleString()}, rank int, doc_id bigint, score bigint")


def _search(segments: DataFrame, run: list, documents: int, terms: int, k: int) -> DataFrame:
    spark = segments.sparkSession
    names = list(dict.fromkeys(t for _, _, counts in run for t in counts))
    wanted = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def count(batches):
        sums = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for t, f in zip(batch.column("terms").to_pylist(), batch.column("frequencies").to_pylist(), strict=True):
                if f:
                    held = [(i, wanted.value[x]) for i, x in enumerate(t.split(b"\n")) if x in wanted.value]
                    at, to = np.array(held, np.int64).reshape(-1, 2).T
                    sums[to] += _numbers(f)[at]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "n"])

    # at most a row for each term of the block of queries
    frequencies = dict(map(tuple, segments.select("terms", "frequencies").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()))
    weights = [weight(documents, frequencies[i]) if i in frequencies else 0 for i in range(len(names))]
    numbers = {t: i for i, t in enumerate(names)}
    asked = spark.sparkContext.broadcast((weights, [(n, [(numbers[t], c) for t, c in counts.items() if weights[numbers[t]] > 0]) for n, _, counts in run]))

    def rank(batches):
        weights, queries = asked.value
        best: dict[int, list] = {n: [] for n, _ in queries}
        for batch in batches:
            for row in batch.to_pylist():
                lists = _lists(row, wanted.value, weights, documents, terms)
                if not lists:
                    continue
                ids = np.frombuffer(row["doc_ids"], "<i8").tolist()
                ids[: row["nulls"]] = [NO_ID] * row["nulls"]
                for n, needed in queries:
                    mine = [(lists[t], c) for t, c in needed if t in lists]
                    if mine:
                        _rank(mine, ids, best[n], k)
        rows = [(n, None if -i == NO_ID else -i, s) for n, entries in best.items() for s, i in entries]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["number", "doc_id", "score"])

    columns = ["nulls", "doc_ids", "lengths", "terms", "frequencies", "sizes", "postings"]
    mine = segments.select(*columns).mapInArrow(rank, "number bigint, doc_id bigint, score bigint")
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = written(index(table(spark, sf_dir, "documents")))
    return search(segments, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""with held as (select row_number() over () as r, doc_id, {_TERMS} as ts from documents),
 sizes as (select r, doc_id, len(ts) as n from held where len(ts) > 0),
 total as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
 asked as (select i, item_id, t, count(*) as times from (select row_number() over () as i, item_id, unnest({_TERMS}) as t from benchmark) group by all),
 found as (select r, t, count(*) as tf from (select r, unnest(ts) as t from held) where t in (select t from asked) group by all),
 weights as (select t, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from found, total group by t, docs),
 scores as (select i, item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) as bigint) as score
  from asked join found using (t) join weights using (t) join sizes using (r), total group by i, item_id, r, doc_id)
 select item_id, rank, doc_id, score from (select *, cast(row_number() over (partition by i order by score desc, doc_id nulls first) as integer) as rank from scores where score > 0) where rank <= 10"""
