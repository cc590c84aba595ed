"""Token-id files: a wavelet matrix for each shard of documents, in one compressed file.

The ids of a shard, one document after another, are written as bit planes. Each distinct id has a code,
the smaller the more often it occurs, so that upper planes are nearly empty. A plane holds one bit of
each code, in the order that a stable partition by the planes above it gives. With rank (ones before a
place) and select (the place of the k-th one) that answers, reading only the chunks of planes that are
met: the token at a place, how often an id occurs in a range, and where. Chunks are compressed each for
itself; a directory holds their places and the ones before them.

    "weft_tokens": a Spark source and sink of a folder of such files

    rows.write.format("weft_tokens").mode("append").save(folder)     # doc_id, ids array<int>
    spark.read.format("weft_tokens").load(folder)                    # doc_id, start, n_tokens, ids

Tasks write files under names of their attempt and tell the driver names and counts alone; the manifest, written
at the end, names the files that count, so lost and repeated attempts leave nothing behind. Rows are
written in the order in which partitions hold them.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weftline.llm.bpe import ByteLevel
from weftline.llm.common import blocks, column, input_bytes, plain, run_folder, table
from weftline.sources import files

MAGIC = b"WEFTWM01"
#: Bits of a chunk of a plane.
CHUNK = 1 << 18
#: Tokens of a shard, at whose reaching it ends with its document.
SHARD = 1 << 22
#: Bytes of documents that a task encodes and writes.
TASK_BYTES = 16 << 20
#: Bytes of text encoded at a time.
ENCODED = 2 << 20
#: Tokens of a batch of documents that a reader returns, or one document where that is longer.
READ_TOKENS = 1 << 20
#: Id that ends a document.
END = 0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def shard_bytes(ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    """The file of a shard: its documents' ids, those of a vocabulary, one after another."""
    counts = np.bincount(ids, minlength=1)
    used = np.flatnonzero(counts)
    counts = counts[used]
    order = np.argsort(-counts, kind="stable")
    code = np.zeros(used[-1] + 1 if len(used) else 1, np.uint16 if len(used) <= 1 << 16 else np.uint32)
    code[used[order]] = np.arange(len(used))
    now = code[ids]
    width = max(1, (len(used) - 1).bit_length()) if len(used) else 0
    parts, at = [], 0

    def put(raw: bytes) -> list[int]:
        nonlocal at
        data = _packed(raw)
        parts.append(data)
        at += len(data)
        return [at - len(data), len(data)]

    nulls = np.asarray(doc_ids.is_null())
    head = {
        "n": len(ids),
        "documents": len(lengths),
        "alphabet": put(used[order].astype("<i4").tobytes()),
        "counts": put(counts[order].astype("<i8").tobytes()),
        "doc_ids": put(doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes()),
        "nulls": put(np.packbits(nulls).tobytes()),
        "lengths": put(lengths.astype("<i8").tobytes()),
        "planes": [],
    }
    for level in range(width):
        ones = (now >> (width - 1 - level) & 1).astype(bool)
        directory, before = [], 0
        for begin in range(0, len(ones), CHUNK):
            part = ones[begin : begin + CHUNK]
            directory.append([*put(np.packbits(part, bitorder="little").tobytes()), before])
            before += int(part.sum())
        head["planes"].append({"zeros": len(ones) - before, "chunks": directory})
        now = np.concatenate((now[~ones], now[ones]))
    header = _packed(json.dumps(head).encode())
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *parts])


class Shard:
    """A shard's file, opened at any place; chunks that are met stay unpacked for as long as it is open."""

    def __init__(self, path: str):
        store, at = files.opened(path)
        self.file = store.open_input_file(at)
        if self._raw(0, 8) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        size = int.from_bytes(self._raw(8, 8), "little")
        self.head = json.loads(zstandard.decompress(self._raw(16, size)))
        self.base, self.n = 16 + size, self.head["n"]
        self.alphabet, self.counts = self._numbers("alphabet", "<i4"), self._numbers("counts", "<i8")
        self.code = {s: i for i, s in enumerate(self.alphabet.tolist())}
        self.planes, self.width = self.head["planes"], len(self.head["planes"])
        self.before = [np.array([c[2] for c in p["chunks"]] + [self.n - p["zeros"]], np.int64) for p in self.planes]
        self.chunks: dict = {}

    def _raw(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _section(self, at: int, size: int) -> bytes:
        return zstandard.decompress(self._raw(self.base + at, size))

    def _numbers(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self._section(*self.head[name]), kind)

    def close(self) -> None:
        self.file.close()

    def doc_ids(self) -> pa.Array:
        nulls = np.unpackbits(np.frombuffer(self._section(*self.head["nulls"]), np.uint8), count=self.head["documents"]).astype(bool)
        return pa.array(self._numbers("doc_ids", "<i8"), mask=nulls)

    def lengths(self) -> np.ndarray:
        return self._numbers("lengths", "<i8")

    # planes

    def _chunk(self, level: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a chunk of a plane, and the ones before each."""
        found = self.chunks.get((level, number))
        if found is None:
            raw = self._section(*self.planes[level]["chunks"][number][:2])
            bits = np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            found = self.chunks[level, number] = bits, np.concatenate(([0], ones))
        return found

    def _look(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits, ones before) at places of a plane; a place may be the plane's end."""
        bit, ones = np.zeros(len(places), bool), np.empty(len(places), np.int64)
        number = places // CHUNK
        for k in np.unique(number).tolist():
            here = np.flatnonzero(number == k)
            if k == len(self.planes[level]["chunks"]):
                ones[here] = self.before[level][-1]
                continue
            bits, counts = self._chunk(level, k)
            inside = places[here] - k * CHUNK
            at, shift = inside >> 6, (inside & 63).astype(np.uint64)
            end = at == len(bits)
            word = bits[np.minimum(at, len(bits) - 1)]
            bit[here] = ~end & ((word >> shift) & np.uint64(1)).astype(bool)
            low = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            ones[here] = self.before[level][k] + counts[at] + np.where(end, 0, low)
        return bit, ones

    def _select(self, level: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """Places of the nth ones, or zeros, of a plane; nth counts from 0."""
        before = self.before[level] if one else np.minimum(np.arange(len(self.before[level])) * CHUNK, self.n) - self.before[level]
        number = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), np.int64)
        for k in np.unique(number).tolist():
            here = np.flatnonzero(number == k)
            bits = np.unpackbits(self._chunk(level, k)[0].view(np.uint8), count=min(CHUNK, self.n - k * CHUNK), bitorder="little")
            out[here] = k * CHUNK + np.flatnonzero(bits == one)[nth[here] - before[k]]
        return out

    # questions

    def access(self, places) -> np.ndarray:
        """The ids at places."""
        now = np.asarray(places, np.int64)
        if len(now) and (now.min() < 0 or now.max() >= self.n):
            raise IndexError(f"places of 0 to {self.n - 1} are asked for")
        code = np.zeros(len(now), np.int64)
        for level in range(self.width):
            bit, ones = self._look(level, now)
            code = code << 1 | bit
            now = np.where(bit, self.planes[level]["zeros"] + ones, now - ones)
        return self.alphabet[code]

    def _down(self, code: int, places: np.ndarray) -> np.ndarray:
        """Where an id's occurrences before each place end in the order below all planes."""
        now = np.asarray(places, np.int64)
        for level in range(self.width):
            ones = self._look(level, now)[1]
            now = self.planes[level]["zeros"] + ones if code >> (self.width - 1 - level) & 1 else now - ones
        return now

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id occurs from a place to before another."""
        if token not in self.code:
            return 0
        low, high = self._down(self.code[token], np.array([begin, self.n if end is None else end]))
        return max(0, int(high - low))

    def occurrences(self, token: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The places of an id from a place to before another, in order."""
        if token not in self.code:
            return np.zeros(0, np.int64)
        code = self.code[token]
        low, high = self._down(code, np.array([begin, self.n if end is None else end]))
        now = np.arange(low, high)
        for level in reversed(range(self.width)):
            one = bool(code >> (self.width - 1 - level) & 1)
            now = self._select(level, now - self.planes[level]["zeros"] if one else now, one)
        return now

    def ids(self) -> np.ndarray:
        """All ids in order: from the sorted codes below the planes back up, a merge for each plane."""
        if not self.n:
            return np.zeros(0, np.int32)
        codes = np.arange(len(self.alphabet))
        turned = np.zeros(len(codes), np.int64)
        for level in range(self.width):
            turned |= (codes >> (self.width - 1 - level) & 1) << level
        order = np.argsort(turned)
        now = np.repeat(self.alphabet[order], self.counts[order])
        for level in reversed(range(self.width)):
            raw = b"".join(self._section(a, b) for a, b, _ in self.planes[level]["chunks"])
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(now)
            zeros = self.planes[level]["zeros"]
            above[~ones] = now[:zeros]
            above[ones] = now[zeros:]
            now = above
        return now


# source and sink


class _Written(WriterCommitMessage):
    def __init__(self, partition: int, shards: list):
        self.partition, self.shards = partition, shards


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, shard: int, tokenizer: str | None):
        self.folder, self.shard, self.tokenizer = folder, shard, tokenizer

    def _documents(self, iterator):
        """(ids of documents, their tokens as a list array)."""
        for batch in iterator:
            if self.tokenizer is None:
                yield batch.column("doc_id"), batch.column("ids")
                continue
            encoder = _encoder(self.tokenizer, False)
            for part in blocks([batch], "text", ENCODED):
                yield part.column("doc_id"), _encoded(encoder, part.column("text"))

    def write(self, iterator):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        shards, held, size = [], [], 0

        def flush():
            nonlocal held, size
            if not held:
                return
            doc_ids, lists = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            held, size = [], 0
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            name = f"part-{partition:07}-{len(shards):04}-{uuid.uuid4().hex}"
            files.write(f"{self.folder}/{name}", shard_bytes(ids, doc_ids, np.diff(offsets)))
            shards.append([name, len(doc_ids), len(ids)])

        for doc_ids, lists in self._documents(iterator):
            total = lists.offsets.to_numpy()
            total = total[1:] - total[0]
            begin = 0
            while begin < len(lists):
                done = int(total[begin - 1]) if begin else 0
                end = min(len(lists), int(np.searchsorted(total, done + self.shard - size, "left")) + 1)
                held.append((doc_ids.slice(begin, end - begin), lists.slice(begin, end - begin)))
                size += int(total[end - 1]) - done
                begin = end
                if size >= self.shard:
                    flush()
        flush()
        return _Written(partition, shards)

    def commit(self, messages):
        shards, start = [], 0
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, documents, tokens in message.shards:
                shards.append({"file": name, "documents": documents, "tokens": tokens, "start": start})
                start += tokens
        files.finish(self.folder, [s["file"] for s in shards], {"shards": shards, "tokens": start})

    def abort(self, messages):
        files.delete(self.folder, [n for n in files.names(self.folder) if n.startswith("part-")])


class _Part(InputPartition):
    def __init__(self, file: str, start: int):
        super().__init__(file)
        self.file, self.start = file, start


class TokenReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        found = files.manifest(self.folder)
        if found is None:
            raise ValueError(f"{self.folder} holds no finished files of token ids")
        return [_Part(s["file"], s["start"]) for s in found["shards"]] or [_Part("", 0)]

    def read(self, partition):
        if not partition.file:
            return
        shard = Shard(f"{self.folder}/{partition.file}")
        doc_ids, lengths, ids = shard.doc_ids(), shard.lengths(), shard.ids().astype("<u4", copy=False)
        shard.close()
        ends = np.cumsum(lengths)
        begin = 0
        while begin < len(lengths):
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + READ_TOKENS, "right")))
            offsets = np.concatenate(([done], ends[begin:end]))
            data = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(((offsets - done) * 4).astype(np.int32)), pa.py_buffer(ids[done : offsets[-1]])])
            yield pa.RecordBatch.from_arrays([doc_ids.slice(begin, end - begin), pa.array(partition.start + offsets[:-1]), pa.array(lengths[begin:end]), data], ["doc_id", "start", "n_tokens", "ids"])
            begin = end


class TokenFiles(DataSource):
    """See above; ids are read as little-endian unsigned 32-bit integers.

    Option tokens_per_file bounds a shard. With option tokenizer, the path of a byte-level tokenizer's file,
    rows are (doc_id, text), and what is written are the texts' ids, each with the end id.
    """

    @classmethod
    def name(cls) -> str:
        return "weft_tokens"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema):
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite):
        folder = self.options["path"]
        if overwrite:
            files.delete(folder, files.names(folder))
        elif files.manifest(folder) is not None:
            raise ValueError(f"{folder} holds token ids already")
        return TokenWriter(folder, int(self.options.get("tokens_per_file", SHARD)), self.options.get("tokenizer"))


_encoders: dict = {}


def _encoder(path: str, plain_specials: bool) -> ByteLevel:
    """A worker's encoder of a file, kept from task to task."""
    key = path, plain_specials
    if key not in _encoders:
        _encoders[key] = ByteLevel(path, plain_specials)
    return _encoders[key]


def _encoded(encoder: ByteLevel, texts: pa.Array) -> pa.ListArray:
    """Ids of texts, each with the end id; null counts as empty."""
    ids, first, _ = encoder.encode(*plain(texts))
    ends = first + np.arange(len(first))
    out = np.full(ends[-1], END, np.int32)
    keep = np.ones(len(out), bool)
    keep[ends[1:] - 1] = False
    out[keep] = ids
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", task_bytes: int = TASK_BYTES, tokens_per_file: int = SHARD) -> None:
    """Ids of all documents as files in ascending order of their ids (nulls first, equal ids by their texts).

    One shuffle deals documents out by ranges of (id, hash of the text), so that an id that very many
    texts share is spread; equal rows stay together. Empty tables give no file. Other columns are ignored.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    size = input_bytes(docs)
    # where the plan does not know its size, it says the largest number there is
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / task_bytes) if size < 1 << 60 else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(column(id_column).cast("bigint").alias("doc_id"), column(text_column).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").write.format("weft_tokens").option("tokenizer", path or tokenizer_path()).option("tokens_per_file", tokens_per_file).mode("append").save(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document of a folder of token ids."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("weft_tokens").load(folder)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
