"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a block of documents on one worker. Its suffix array holds the word positions that can
start a benchmark window, sorted by the words that follow: positions whose first words start no
window match nothing and are left out beforehand, by a bitmap of the windows' first words. Each test
suffix (each window of a benchmark item) is binary-searched in it; the found range gives every
verbatim occurrence, verified byte for byte since words are looked up by hash. Occurrences that follow
one another in both texts join into the longest matches, and these are what hits, items and removal
are computed from. Documents never leave their partition, so no key or source can make a partition hot.

The benchmark goes to workers in broadcast blocks of at most BENCHMARK_BYTES of text; a larger one
takes several passes, each over all documents, so nothing is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from weftline.llm.common import blocks, column, cut, filtered, packed, plain, table
from weftline.llm.words import equal, hashes, lowered, mix, spans

WINDOW = 13
#: A document is contaminated if its hit words times this are at least its words.
SHARE = 20
#: Most benchmark text, in bytes, in one broadcast; one item may be longer and then comes alone.
BENCHMARK_BYTES = 16 << 20
FILTER_BITS = 1 << 22


class Shard:
    """The words of some texts: lower-cased bytes, where words begin and end, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.first, self.starts, ends = spans(data, offsets, "letters")
        self.low, self.lengths = lowered(data), ends - self.starts

    def hashes(self, seed: int) -> np.ndarray:
        return hashes(self.low, self.starts, self.lengths, seed)


class TestSuffixes:
    """The windows of some benchmark items: distinct word rows by window length, and who has them."""

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        self.items = [r[0] for r in rows]
        texts = [(r[1] or "").encode() for r in rows]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        own = Shard(np.frombuffer(b"".join(texts), np.uint8), offsets)
        # words are told apart by hash; a seed under which two of the benchmark's words share one is not used
        for self.seed in range(100):
            self.vocabulary, example, ids = np.unique(own.hashes(self.seed), return_index=True, return_inverse=True)
            self.low, self.starts, self.lengths = own.low, own.starts[example], own.lengths[example]
            if self.spelled(own, np.arange(len(ids)), ids).all():
                break
        ids = ids.astype(np.int64) + 1
        self.groups = []
        first = own.first
        lengths = np.diff(first)
        sizes = np.minimum(lengths, window)
        for size in np.unique(sizes[sizes > 0]):
            whose = np.flatnonzero(sizes == size)
            counts = lengths[whose] - size + 1
            item = np.repeat(whose, counts)
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            matrix = ids[(first[item] + offset)[:, None] + np.arange(size)]
            rows_, inverse = np.unique(matrix, axis=0, return_inverse=True)
            order = np.argsort(inverse.ravel(), kind="stable")
            bounds = np.searchsorted(inverse.ravel()[order], np.arange(len(rows_) + 1))
            lead = min(3, int(size))
            bitmap = np.zeros(FILTER_BITS, bool)
            bitmap[self.slot([rows_[:, k] for k in range(lead)])] = True
            heads = np.zeros(len(self.vocabulary) + 1, bool)
            heads[rows_[:, 0]] = True
            self.groups.append((int(size), lead, heads, bitmap, self.pack(rows_), bounds, item[order], offset[order]))

    @staticmethod
    def slot(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (mix(h) >> np.uint64(42)).astype(np.int64)

    @staticmethod
    def pack(matrix: np.ndarray) -> list[np.ndarray]:
        """Two words in each 64-bit column; rows compare as their columns do, first to last."""
        if matrix.shape[1] % 2:
            matrix = np.column_stack([matrix, np.zeros(len(matrix), np.int64)])
        return [matrix[:, k] << 31 | matrix[:, k + 1] for k in range(0, matrix.shape[1], 2)]

    def ids(self, hashes_: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary by hash, 0 if it has none."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes_), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes_), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes_, at + 1, 0)

    def spelled(self, shard: Shard, words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether words of a shard are, byte for byte, the vocabulary's words of these numbers (from 0)."""
        same = shard.lengths[words] == self.lengths[numbers]
        at = np.flatnonzero(same)
        words, numbers = words[at], numbers[at]
        same[at] = equal(shard.low, shard.starts[words], self.low, self.starts[numbers], self.lengths[numbers])
        return same

    def search(self, shard: Shard):
        """Yields, for each window length, (length, suffix array, low, high, group): window w occurs at array[low[w]:high[w]]."""
        ids = self.ids(shard.hashes(self.seed))
        last = np.repeat(shard.first[1:], np.diff(shard.first))  # end of each word's document
        for group in self.groups:
            size, lead, heads, bitmap, tests = group[:5]
            at = np.flatnonzero(heads[ids])
            at = at[at + size <= last[at]]
            at = at[bitmap[self.slot([ids[at + k] for k in range(lead)])]]
            while len(at):
                # the shard's suffix array, over the positions left, to the depth of a window
                columns = self.pack(ids[at[:, None] + np.arange(size)])
                order = np.lexsort(columns[::-1])
                array, columns = at[order], [c[order] for c in columns]
                low = self._bound(columns, tests, len(array), strict=True)
                high = self._bound(columns, tests, len(array), strict=False)
                # what was found by hash is verified by its bytes
                change = np.zeros(len(ids) + 1, np.int64)
                found = array[self._inside(low, high)]
                np.add.at(change, found, 1)
                np.add.at(change, found + size, -1)
                words = np.flatnonzero(np.cumsum(change[:-1]))
                wrong = words[~self.spelled(shard, words, ids[words] - 1)]
                if not len(wrong):
                    if len(found):
                        yield size, array, low, high, group
                    break
                ids[wrong] = 0
                at = at[(ids[at[:, None] + np.arange(size)] > 0).all(axis=1)]

    @staticmethod
    def _inside(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """All places from low to high, window after window."""
        counts = high - low
        return np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    @staticmethod
    def _bound(columns: list[np.ndarray], tests: list[np.ndarray], n: int, strict: bool) -> np.ndarray:
        """Binary search of all tests at once: first place whose suffix is not below (strict), or above, the test."""
        low, high = np.zeros(len(tests[0]), np.int64), np.full(len(tests[0]), n)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            probe = np.minimum(middle, n - 1)
            before = np.full(len(low), not strict)
            for c, t in zip(columns[::-1], tests[::-1], strict=True):
                v = c[probe]
                before = (v < t) | ((v == t) & before)
            low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
        return low

    def matches(self, shard: Shard):
        """Yields (word, length, item, offset), arrays, of the longest verbatim matches of a window or more.

        An item's windows are taken last to first; a match that starts where one of the next window's
        starts a word later is that one, longer by a word.
        """
        run = np.zeros(len(shard.starts) + 1, np.int64)
        for size, array, low, high, group in self.search(shard):
            bounds, item, offset = group[5:8]
            places = self._inside(bounds[:-1][high > low], bounds[1:][high > low])
            window = np.repeat(np.flatnonzero(high > low), np.diff(bounds)[high > low])
            order = np.lexsort((-offset[places], item[places]))
            before = np.empty(0, np.int64)  # where the window before, in this order, starts, and whose it is
            last = (-1, -1)
            for i, o, w in zip(item[places][order].tolist(), offset[places][order].tolist(), window[order].tolist(), strict=True):
                here = array[low[w] : high[w]]
                if last != (i, o + 1):
                    yield from self._report(before, run, size, *last)
                    run[before] = 0
                    before = np.empty(0, np.int64)
                length = run[here + 1] + 1
                # matches that do not start a word earlier are whole
                whole = np.setdiff1d(before, here + 1, assume_unique=True)
                yield from self._report(whole, run, size, *last)
                run[before] = 0
                run[here] = length
                before, last = here, (i, o)
            yield from self._report(before, run, size, *last)
            run[before] = 0

    def _report(self, at: np.ndarray, run: np.ndarray, size: int, item: int, offset: int):
        if len(at):
            yield at, run[at] + size - 1, item, offset

    def judge(self, shard: Shard):
        """(mask of hit words, items met by each document that has any, longest match of each: (-length, word, item as text or null))."""
        change = np.zeros(len(shard.starts) + 1, np.int64)
        met: dict[int, set[int]] = {}
        best: dict[int, tuple] = {}
        for at, length, item, _ in self.matches(shard):
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            document = np.searchsorted(shard.first, at, "right") - 1
            name = None if self.items[item] is None else str(self.items[item])
            for d, n, p in zip(document.tolist(), length.tolist(), (at - shard.first[document]).tolist(), strict=True):
                met.setdefault(d, set()).add(item)
                best[d] = _longer(best.get(d), (-n, p, name))
        return np.cumsum(change[:-1]) > 0, met, best


def _longer(a: tuple | None, b: tuple | None) -> tuple | None:
    """The longer match; of equal ones the first in the text, then the first item."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda m: (m[0], m[1], m[2] is None, m[2] or ""))


def benchmark_blocks(bench: DataFrame, item_column: str, text_column: str, most: int = BENCHMARK_BYTES) -> list:
    """Broadcasts of the benchmark's windows, each of at most `most` bytes of text or one item."""
    spark = bench.sparkSession
    found, rows, size = [], [], 0
    for row in bench.select(item_column, text_column).toLocalIterator():
        n = len((row[1] or "").encode())
        if rows and size + n > most:
            found.append(spark.sparkContext.broadcast(TestSuffixes(rows)))
            rows, size = [], 0
        rows.append(tuple(row))
        size += n
    if rows:
        found.append(spark.sparkContext.broadcast(TestSuffixes(rows)))
    return found


#: What annotate() finds out about a document, after its id.
FOUND = "n_words bigint, n_hit bigint, items array<string>, longest bigint, longest_word bigint, longest_item string"


def annotate(docs: DataFrame, bench: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", most: int = BENCHMARK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, longest, longest_word, longest_item) of every document.

    items: the sorted distinct items, as strings, with windows that occur in the document; longest: the
    words of the longest verbatim match, 0 if there is none, where it starts and in which item. A null,
    empty or wordless text has no words and no hits; items without words have no window, items with
    a null id count for hits and are left out of items; repeated rows, items and ids each keep their
    own row; empty tables give empty results or no hits; other columns are ignored.
    """
    found = benchmark_blocks(bench, item_column, text_column, most)
    out = StructType([docs.schema[id_column], *StructType.fromDDL(FOUND).fields])
    if len(found) <= 1:

        def run(batches):
            tests = found[0].value if found else TestSuffixes([])
            for batch in blocks(batches, text_column):
                n_words, masks, items, best = _judge(tests, batch.column(text_column))
                yield pa.RecordBatch.from_arrays([batch.column(id_column), *_found(n_words, [int(m.sum()) for m in masks], items, best)], names=out.names)

        return docs.select(id_column, text_column).mapInArrow(run, out)
    # several passes: each adds its items, its longest match, and its hit words as a bitmap, to the rows
    state = StructType([StructField("id", docs.schema[id_column].dataType), *StructType.fromDDL(f"text string, hits binary, {FOUND.split(', ', 2)[2]}").fields])
    now = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), *((F.array() if f.name == "items" else F.lit(None)).cast(f.dataType).alias(f.name) for f in state.fields[2:]))
    for number, block in enumerate(found):
        now = now.mapInArrow(_pass(block), state)
        if number % 4 == 3:
            now = cut(now)

    def finish(batches):
        for batch in blocks(batches):
            n_words = np.diff(Shard(*plain(batch.column("text"))).first)
            hit = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in batch.column("hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), *(batch.column(c) for c in out.names[3:])], names=out.names)

    return now.mapInArrow(finish, out)


def _found(n_words, n_hit, items, best) -> list[pa.Array]:
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array(items, pa.list_(pa.string())),
        pa.array([0 if b is None else -b[0] for b in best], pa.int64()),
        pa.array([None if b is None else b[1] for b in best], pa.int64()),
        pa.array([None if b is None else b[2] for b in best], pa.string()),
    ]


def _pass(block):
    def run(batches):
        tests = block.value
        for batch in blocks(batches):
            n_words, masks, items, best = _judge(tests, batch.column("text"))
            hits = [np.packbits(m) if h is None else np.packbits(m) | np.frombuffer(h, np.uint8) for m, h in zip(masks, batch.column("hits").to_pylist(), strict=True)]
            items = [sorted({*x, *old}) for x, old in zip(items, batch.column("items").to_pylist(), strict=True)]
            old = zip(*(batch.column(c).to_pylist() for c in ("longest", "longest_word", "longest_item")), strict=True)
            best = [_longer(b, (-n, w, i) if n else None) for b, (n, w, i) in zip(best, old, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array([h.tobytes() for h in hits], pa.binary()), *_found(n_words, n_words, items, best)[2:]], names=batch.schema.names)

    return run


def _judge(tests: TestSuffixes, texts: pa.Array):
    """(words, masks of hit words, names of items met, longest match) of each text."""
    shard = Shard(*plain(texts))
    mask, met, best = tests.judge(shard)
    items = [sorted({str(tests.items[i]) for i in met.get(d, ()) if tests.items[i] is not None}) for d in range(len(texts))]
    first = shard.first
    return np.diff(first), [mask[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], items, [best.get(d) for d in range(len(texts))]


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    return (F.col(n_hit) > 0) & (F.lit(SHARE) * F.col(n_hit) >= F.col(n_words))


def matches(docs: DataFrame, bench: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """(id, word, length, item, offset): all longest verbatim matches of a window or more, in words.

    word and offset count from 0 in the document and the item. Cases as in annotate().
    """
    found = benchmark_blocks(bench, item_column, text_column)
    out = StructType([docs.schema[id_column], *StructType.fromDDL("word bigint, length bigint").fields, StructField("item", bench.schema[item_column].dataType), *StructType.fromDDL("offset bigint").fields])
    kinds = [f.type for f in to_arrow_schema(out)]

    def run(batches):
        for batch in blocks(batches, text_column):
            shard = Shard(*plain(batch.column(text_column)))
            for block in found:
                for at, length, item, offset in block.value.matches(shard):
                    document = np.searchsorted(shard.first, at, "right") - 1
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(document)), pa.array(at - shard.first[document]), pa.array(length), pa.array([block.value.items[item]] * n, kinds[3]), pa.array([offset] * n, pa.int64())], names=out.names)

    return docs.select(id_column, text_column).mapInArrow(run, out)


def remove(docs: DataFrame, bench: DataFrame, text_column: str = "text", item_column: str = "item_id", most: int = BENCHMARK_BYTES) -> DataFrame:
    """docs, all columns, without the contaminated documents. Cases as in annotate()."""
    found = benchmark_blocks(bench, item_column, text_column, most)
    if len(found) > 1:
        rows = packed(docs, text=column(text_column)).withColumnRenamed("weft_row", "doc_id")
        judged = annotate(rows, bench.select(F.col(item_column).alias("item_id"), F.col(text_column).alias("text")), most=most)
        return judged.where(~contaminated()).select("doc_id.*")

    def keep(batch):
        n_words, masks, _, _ = _judge(found[0].value if found else TestSuffixes([]), batch.column("text"))
        n_hit = np.array([m.sum() for m in masks], np.int64)
        return ~((n_hit > 0) & (SHARE * n_hit >= n_words))

    return filtered(docs, keep, text_column)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.col("longest").alias("longest_match"),
        F.col("longest_word").alias("longest_match_word"),
        F.col("longest_item").alias("longest_match_item"),
    )
