"""Two tokenizers' tokens of the same texts, aligned by bytes, with how often pairs of tokens meet in the corpus.

A whole block of texts is laid end to end. The byte places where tokens of A end and those where tokens
of B end are counted once; texts are cut into groups where both end. Between two neighbouring places
lies one stretch of bytes under one token of A and one of B, so each place is the end of exactly one link.
Prefix sums over the places give every text's numbers.

How many documents hold a pair is counted by chunks, runs of documents of a task: a chunk sends each of
its pairs once, with the number of its documents, however many rows it has, so that no pair is hot. Counts come
back to the chunk, whose documents are in a table bucketed by chunk and move no more.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import sentencepiece
from weftline.llm.bpe import ByteLevel, Pieces, gathered
from weftline.llm.common import blocks, column, input_bytes, plain, run_folder, table, written
from weftline.llm.packing import packed_numbers, unpacked_numbers
from weftline.llm.tokens import tokenizer_path

#: Pairs, each once for a document, at whose reaching a chunk ends with its block.
CHUNK = 4_000_000
#: Pairs in a row of a chunk's dictionary.
SLICE = 1 << 16
#: Bytes of text aligned at a time.
BLOCK = 2 << 20
#: Bytes of documents to a bucket of the table of documents.
BUCKET_BYTES = 64 << 20


class PieceLevel:
    """A SentencePiece model's file; texts come with the space that the model adds."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.Model(data)
        self.size = len(self.model.pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == self.model.BYTE else p.replace(sentencepiece.SPACE, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds.tolist(), strict=True)]
        self.pieces = Pieces(self._encode, self._is)

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        split = [self.model.words.findall(p.decode().replace(" ", sentencepiece.SPACE)) for p in pieces]
        new = list(dict.fromkeys(w for words in split for w in words))
        found = dict(zip(new, self.model.encode_words(new), strict=True))
        return [found[words[0]] if len(words) == 1 else [i for w in words for i in found[w]] for words in split]

    def _is(self, piece: bytes, ids: list[int]) -> bool:
        return b"".join([self.bytes[i] for i in ids]) == piece

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ByteLevel.encode(); pieces are spaces and what follows up to the next space."""
        blank = data == 32
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[offsets[:-1]] = True
        starts = np.flatnonzero(start)
        found = self.pieces.find(data, starts, np.append(starts[1:], len(data)))
        return gathered(self.pieces, found, starts, offsets)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
    return out, offsets + np.arange(n + 1)


def lengths_of(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


class Alignment:
    """Tokens of A and B of texts that lie end to end, with the same bytes; text i has tokens first_a[i] to first_a[i + 1]."""

    def __init__(self, a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray):
        self.a, self.b, self.first_a, self.first_b = a, b, first_a, first_b
        ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        total = int(ends_a[-1]) if len(a) else 0
        marks = np.bincount(np.concatenate((ends_a, ends_b)), minlength=total + 1)
        is_a = np.zeros(total + 1, bool)
        is_a[ends_a] = True
        places = np.flatnonzero(marks)
        self.cut = marks[places] == 2
        self.is_a = is_a[places]
        self.is_b = ~self.is_a | self.cut
        before = lambda x: np.cumsum(x) - x
        self.link_a, self.link_b = before(self.is_a), before(self.is_b)
        # texts end where links end
        text_ends = np.concatenate(([0], ends_a))[first_a]
        self.first = np.searchsorted(places, text_ends, "right")
        self.groups = np.concatenate(([0], np.cumsum(self.cut)))

    def per_text(self) -> tuple[np.ndarray, ...]:
        """n_a, n_b, n_groups, n_links."""
        return np.diff(self.first_a), np.diff(self.first_b), np.diff(self.groups[self.first]), np.diff(self.first)

    def group_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each token's group, of A and of B."""
        number = self.groups[:-1]
        return number[self.is_a], number[self.is_b]

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, pairs, times): each text's distinct pairs of ids, as a * size_b + b, in order, and how often it links them."""
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        keys = np.sort(text << 40 | self.a[self.link_a].astype(np.int64) * size_b + self.b[self.link_b])
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        owner = keys[at] >> 40
        return np.searchsorted(owner, np.arange(len(self.first))), keys[at] & (1 << 40) - 1, np.diff(np.append(at, len(keys)))

    def written_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends): a1,a2|b1;a3|b2 of each text, one after another, and where they begin and end."""
        group_a, group_b = self.group_of()
        n = int(self.groups[-1])
        count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        at_a = np.arange(len(self.a)) + (np.cumsum(count_b) - count_b)[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(count_a)[group_b]
        last = lambda g: np.append(g[1:] != g[:-1], np.ones(min(len(g), 1), bool))
        after_b = last(group_b).astype(np.int64)
        ends = self.first_b[1:][np.diff(self.first_b) > 0]
        after_b[ends - 1] = 2
        text_a, text_b = decimals(int(self.a.max(initial=0)) + 1, b",|"), decimals(int(self.b.max(initial=0)) + 1, b",;\0")
        width = max(text_a.shape[2], text_b.shape[2])
        out = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        out[at_a, : text_a.shape[2]] = text_a[self.a, last(group_a).astype(np.int64)]
        out[at_b, : text_b.shape[2]] = text_b[self.b, after_b]
        some = out != 0
        sizes = np.concatenate(([0], np.cumsum(some.sum(1))))
        return out[some], sizes[self.first_a + self.first_b]


@cache
def _decimals(bits: int, after: bytes) -> np.ndarray:
    n, width = 1 << bits, len(str((1 << bits) - 1))
    numbers = np.arange(n)
    out = np.zeros((n, len(after), width + 1), np.uint8)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        out[:, :, k] = np.where((numbers >= power) | (power == 1), 48 + numbers // power % 10, 0)[:, None]
    out[:, :, width] = np.frombuffer(after, np.uint8)
    return out


def decimals(n: int, after: bytes) -> np.ndarray:
    """[number, which, byte]: numbers below n in decimal digits, each of the bytes after it; zeros are to be left out."""
    return _decimals(max(n - 1, 1).bit_length(), after)


_encoders: dict = {}


def _both(path_a: str, data_b: bytes) -> tuple[ByteLevel, PieceLevel, np.ndarray, np.ndarray]:
    """A worker's two encoders and their tokens' lengths, kept from task to task."""
    key = path_a, hashlib.sha256(data_b).digest()
    if key not in _encoders:
        a, b = ByteLevel(path_a, True), PieceLevel(data_b)
        _encoders[key] = a, b, lengths_of(a.bytes), lengths_of(b.bytes)
    return _encoders[key]


def align(texts: pa.Array, both: tuple) -> tuple[np.ndarray, Alignment]:
    """(which, alignment): the texts that have tokens, and their tokens."""
    a, b, length_a, length_b = both
    data, offsets = plain(texts)
    some = np.flatnonzero(np.diff(offsets) > 0)
    data, offsets = spaced(data, np.concatenate(([0], offsets[1:][some])))
    ids_a, first_a, good_a = a.encode(data, offsets)
    ids_b, first_b, good_b = b.encode(data, offsets)
    good = good_a & good_b
    if not good.all():
        keep = lambda first: np.repeat(good, np.diff(first))
        bounds = lambda first: np.concatenate(([0], np.cumsum(np.diff(first)[good])))
        ids_a, ids_b, first_a, first_b = ids_a[keep(first_a)], ids_b[keep(first_b)], bounds(first_a), bounds(first_b)
    return some[good], Alignment(ids_a, first_a, ids_b, first_b, length_a, length_b)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, bytes]:
    return path_a or tokenizer_path(), open(path_b or sentencepiece.model_path(), "rb").read()


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): both tokenizers' ids, and how many of each lie before the end of each group.

    Texts that are null, empty or not given back byte for byte by both have empty lists. Rows are
    independent: repeated rows and ids give repeated results, null ids stay null, an empty table gives an
    empty one, other columns are ignored.
    """
    path_a, data_b = _paths(path_a, path_b)

    def spread(values, first, which, n):
        offsets = np.zeros(n + 1, np.int32)
        offsets[which + 1] = np.diff(first)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(values, pa.int32()))

    def run(batches):
        both = _both(path_a, data_b)
        for batch in blocks(batches, "text", BLOCK):
            which, found = align(batch.column("text"), both)
            n = batch.num_rows
            cut, first = np.flatnonzero(found.cut), found.groups[found.first]
            each = np.diff(first)
            ends_a = found.link_a[cut] + 1 - np.repeat(found.first_a[:-1], each)
            ends_b = found.link_b[cut] + 1 - np.repeat(found.first_b[:-1], each)
            columns = [spread(found.a, found.first_a, which, n), spread(found.b, found.first_b, which, n), spread(ends_a, first, which, n), spread(ends_b, first, which, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select(column(id_column).cast("bigint").alias("doc_id"), column(text_column).alias("text")).mapInArrow(run, "doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _chunks(docs: DataFrame, path_a: str, data_b: bytes, size: int) -> DataFrame:
    """Documents, with their pairs as places in their chunk's dictionary, and the dictionaries, in slices."""
    names = ["chunk", "doc_id", *NUMBERS, "groups_sha256", "places", "times", "at", "pairs", "documents"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def flush(chunk, held):
        keys, places, counts = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
        done = 0
        for ids, numbers, first, pairs, times, shas in held:
            here = places[done : done + len(pairs)]
            done += len(pairs)
            steps = np.diff(here, prepend=0)
            # a text's places ascend, so that steps are small; its first counts from 0
            begins = first[:-1][np.diff(first) > 0]
            steps[begins] = here[begins]
            columns = []
            for values in (steps, times - 1):
                data, ends = packed_numbers(values)
                offsets = np.concatenate(([0], ends))[first]
                columns.append(pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]))
            n = len(ids)
            arrays = [pa.array(np.full(n, chunk)), ids, *map(pa.array, numbers), pa.array(shas, pa.string()), *columns, *(pa.nulls(n, k) for k in kinds[9:])]
            yield pa.RecordBatch.from_arrays(arrays, names)
        for at in range(0, len(keys), SLICE):
            row = [[chunk], [None], [None], [None], [None], [None], [None], [None], [None], [at], [keys[at : at + SLICE]], [counts[at : at + SLICE].astype(np.int32)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    def run(batches):
        from pyspark import TaskContext

        both = _both(path_a, data_b)
        chunk, held, entries = TaskContext.get().partitionId() << 32, [], 0
        for batch in blocks(batches, "text", BLOCK):
            which, found = align(batch.column("text"), both)
            n = batch.num_rows
            numbers = np.zeros((4, n), np.int64)
            numbers[:, which] = found.per_text()
            text, ends = found.written_groups()
            shas = np.full(n, "", object)
            shas[which] = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            first, pairs, times = found.pairs(both[1].size)
            spread = np.zeros(n + 1, np.int64)
            spread[which + 1] = np.diff(first)
            held.append((batch.column("doc_id"), numbers, np.cumsum(spread), pairs, times, shas))
            entries += len(pairs)
            if entries >= size:
                yield from flush(chunk, held)
                chunk, held, entries = chunk + 1, [], 0
        if held:
            yield from flush(chunk, held)

    schema = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, at bigint, pairs array<bigint>, documents array<int>"
    return docs.select(column("doc_id").cast("bigint").alias("doc_id"), column("text").cast("string").alias("text")).mapInArrow(run, schema)


def _bucketed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows, computed once, as a table in the shared folder whose files are bucketed by key."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(size / BUCKET_BYTES) if size < 1 << 60 else 0)
    name = f"weft_{uuid.uuid4().hex}"
    rows.write.option("path", run_folder(spark, "table")).option("compression", "zstd").bucketBy(min(buckets, 100_000), key).saveAsTable(name)
    found = spark.table(name)
    found.schema  # noqa: B018 - resolved now; files stay when the catalog forgets the table's name
    spark.sql(f"drop table {name}")
    return found


def alignment_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A link is an occurrence of a token of A and one of B over a common byte; a pair's count is the number
    of documents that link it. Texts that are null, empty or not given back byte for byte by both
    tokenizers have no tokens: zeros, and an empty string as digest. Every row counts as a document, also where
    rows or ids repeat or the id is null; an empty table gives an empty result; other columns are ignored.
    """
    path_a, data_b = _paths(path_a, path_b)
    rows = _bucketed(_chunks(docs, path_a, data_b, chunk), "chunk", input_bytes(docs))
    size_b = len(_both(path_a, data_b)[1].bytes)
    entries = rows.where("pairs is not null").select("chunk", "at", F.posexplode(F.arrays_zip("pairs", "documents")).alias("i", "e")).select("chunk", (F.col("at") + F.col("i")).cast("int").alias("place"), F.col("e.pairs").alias("pair"), F.col("e.documents").alias("documents"))
    counted, _ = written(entries.selectExpr("chunk", "place", f"cast(pair div {size_b} as int) as a", "sum(documents) over (partition by pair) as total"))
    # a row for each id of A
    best = counted.groupBy("a").agg(F.max("total").alias("best"))
    scored = counted.join(F.broadcast(best), "a").select("chunk", "place", "total", (F.col("total") == F.col("best")).alias("is_best"))
    names = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        total, is_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        total[place], is_best[place] = right.column("total").to_numpy(), right.column("is_best").to_numpy()
        sums = []
        for batch in left.to_batches():
            counts, (steps, times) = None, (plain(batch.column(c)) for c in ("places", "times"))
            # numbers of a text: those that end in its bytes
            counts = np.diff(np.concatenate(([0], np.cumsum(steps[0] < 128)))[steps[1]])
            values, repeats = unpacked_numbers(steps[0]), unpacked_numbers(times[0]) + 1
            ends = np.cumsum(counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            running = np.cumsum(values)
            base = np.concatenate(([0], running))[ends - counts]
            at = running - base[owner]
            sums.append([np.bincount(owner, (x[at] * repeats).astype(np.float64), len(counts)) if max_exact(x, repeats) else exact(owner, x[at] * repeats, len(counts)) for x in (is_best, total)])
        n_best, count_sum = (np.concatenate([s[k] for s in sums]).astype(np.int64) if sums else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table([*(left.column(c) for c in names[:5]), pa.array(n_best), pa.array(count_sum), left.column("groups_sha256")], names=names)

    documents = rows.where("pairs is null").select("chunk", "doc_id", *NUMBERS, "groups_sha256", "places", "times")
    return documents.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(score, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def max_exact(values: np.ndarray, times: np.ndarray) -> bool:
    """Whether sums of products are whole in doubles, whatever rows are summed."""
    return float(values.max(initial=0)) * float(times.sum()) < 2**53


def exact(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, values)
    return out


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
