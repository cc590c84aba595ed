"""Files of one JSON array of any size, read and written by many tasks.

Reading: a file is cut into ranges of bytes. Where a range starts inside a string or how deep it is cannot be
told from the range alone, so each is scanned once under both assumptions: how the range changes
depth, where its quotes leave the reader, and how many elements would start at each depth below that of its
start. The driver composes these few numbers from range to range; then every range knows its state, and
the number of its first element. A task reads the elements that start in its range, beyond its
end if the last one goes on.

    "weft_json_array": a Spark source of (record_no, json), and a sink of json texts

Writing: tasks write their rows' texts as parts of the array; names and sizes go to the driver, which writes a
manifest. One more task puts the parts together into the file, streaming, and moves it into place, so that a
failed write leaves no file. No text passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weftline.sources import files
from weftline.sources.batches import in_pieces

#: Bytes of a range.
RANGE = 32 << 20
#: Ranges of a file, at the most, unless they would be longer than RANGE.
RANGES = 1 << 10
#: Bytes read at a time, and beyond the end of a range at first.
PIECE, BEYOND = 4 << 20, 64 << 10
#: Rows of a batch that a task hands on, or fewer where they hold so many bytes.
ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of texts that a task lays out and writes at a time.
WRITTEN = 4 << 20
QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
#: What each byte does to the depth outside strings.
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]] = 1
STEP[[ord("]"), ord("}")]] = -1
WHITE = b" \t\n\r"


class Marks:
    """The bytes of a piece that matter: brackets and commas outside strings, for either state of its start.

    slashes is the parity of the backslashes right before the piece.
    """

    def __init__(self, data: bytes, slashes: int):
        raw = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(raw == QUOTE)
        plain = np.flatnonzero(raw != BACKSLASH)
        # a quote after an odd run of backslashes belongs to its string
        before = np.searchsorted(plain, quotes) - 1
        run = quotes - 1 - np.where(before >= 0, plain[np.maximum(before, 0)] if len(plain) else 0, -1) if len(quotes) else quotes
        run = run + np.where(before < 0, slashes, 0)
        self.quotes = quotes[run % 2 == 0]
        end = len(raw) - 1 - (plain[-1] if len(plain) else -1)
        self.slashes = int(end + (0 if len(plain) else slashes)) % 2
        self.places = np.flatnonzero((STEP[raw] != 0) | (raw == COMMA))
        self.inside = np.searchsorted(self.quotes, self.places) % 2
        self.step, self.comma = STEP[raw[self.places]].astype(np.int64), raw[self.places] == COMMA

    def outside(self, in_string: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, steps, commas) outside strings, if the piece starts in a string or not."""
        some = self.inside == in_string
        return self.places[some], self.step[some], self.comma[some]


def _slashes(source, begin: int) -> int:
    """The parity of the backslashes right before a place of a file."""
    run, at = 0, begin
    while at > 0:
        size = min(at, 1 << 12)
        source.seek(at - size)
        data = source.read(size)
        kept = data.rstrip(b"\\")
        run += size - len(kept)
        if kept:
            break
        at -= size
    return run % 2


def scan_range(path: str, begin: int, end: int) -> dict:
    """What a range does, for either state of its start: its quotes' parity, the depth it adds, starts of elements by depth."""
    store, at = files.opened(path)
    found = {"quotes": 0, "depth": [0, 0], "starts": [{}, {}]}
    with store.open_input_file(at) as source:
        slashes = _slashes(source, begin)
        source.seek(begin)
        while begin < end:
            data = source.read(min(PIECE, end - begin))
            if not data:
                break
            marks = Marks(data, slashes)
            slashes = marks.slashes
            for state in (0, 1):
                _, step, comma = marks.outside(state ^ found["quotes"])
                depth = found["depth"][state] + np.cumsum(step)
                # an element starts after a comma at depth 1, the first after the bracket that leads there
                levels, counts = np.unique(depth[comma | (step > 0)], return_counts=True)
                starts = found["starts"][state]
                for level, n in zip(levels.tolist(), counts.tolist(), strict=True):
                    # seen from a start of depth 0 or more, depth 1 is no higher than 1
                    if level <= 1:
                        starts[level] = starts.get(level, 0) + n
                found["depth"][state] += int(step.sum())
            found["quotes"] ^= len(marks.quotes) % 2
            begin += len(data)
    return found


def compose(scanned: list[dict]) -> list[tuple[int, int, int]]:
    """(in_string, depth, first) at the start of each range: first is the number of the first element that starts in it."""
    out, in_string, depth, first = [], 0, 0, 0
    for r in scanned:
        out.append((in_string, depth, first))
        first += r["starts"][in_string].get(1 - depth, 0)
        depth += r["depth"][in_string]
        in_string ^= r["quotes"]
    if in_string or depth:
        raise ValueError("the file does not end where its array does")
    return out


def elements(path: str, begin: int, end: int, in_string: int, depth: int) -> Iterator[bytes]:
    """The elements that start in a range, as they stand; at its commas or after the array's bracket."""
    store, at = files.opened(path)
    with store.open_input_file(at) as source:
        slashes = _slashes(source, begin)
        source.seek(begin)
        held: list[bytes] | None = None
        beyond = BEYOND
        while True:
            # the range itself, then as much more as the element that goes on needs
            size = end - begin if begin < end else beyond
            beyond = beyond if begin < end else 2 * beyond
            data = source.read(max(1, min(PIECE, size)))
            if not data:
                if held is not None:
                    raise ValueError("the file ends inside its array")
                return
            marks = Marks(data, slashes)
            slashes = marks.slashes
            places, step, comma = marks.outside(in_string)
            after = depth + np.cumsum(step)
            # an element ends at a comma of depth 1 or at the last bracket; the next starts after the comma
            cuts = np.flatnonzero(comma & (after == 1) | (step > 0) & (after == 1) | (step < 0) & (after == 0))
            from_ = 0
            for i in cuts.tolist():
                place = int(places[i])
                if held is not None:
                    held.append(data[from_:place])
                    yield b"".join(held).strip(WHITE)
                    held = None
                if step[i] < 0 or begin + place >= end:
                    return
                held, from_ = [], place + 1
            if held is not None:
                held.append(data[from_:])
            depth = int(after[-1]) if len(after) else depth
            in_string ^= len(marks.quotes) % 2
            begin += len(data)
            if begin >= end and held is None:
                return


# source and sink


class _Range(InputPartition):
    def __init__(self, plan: list | None):
        super().__init__(plan)
        self.plan = plan


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, plan: list):
        self.path, self.plan = path, plan

    def __getstate__(self):
        # goes to every task, which has its own range
        return self.__dict__ | {"plan": []}

    def partitions(self):
        return [_Range(p) for p in self.plan] or [_Range(None)]

    def read(self, partition):
        if partition.plan is None:
            return
        begin, end, in_string, depth, number = partition.plan
        held, size, first = [], 0, number
        # an empty array has one element that is nothing
        for text in filter(None, elements(self.path, begin, end, in_string, depth)):
            held.append(text.decode())
            size += len(text)
            if len(held) == ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.string())], ["record_no", "json"])
                first, held, size = first + len(held), [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.string())], ["record_no", "json"])


class _Part(WriterCommitMessage):
    def __init__(self, partition: int, name: str | None, rows: int, size: int):
        self.partition, self.name, self.rows, self.size = partition, name, rows, size


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, indent: int | None):
        self.folder, self.indent = folder, indent

    def write(self, iterator):
        from pyspark import TaskContext

        partition, rows, size, out = TaskContext.get().partitionId(), 0, 0, None
        pad, between = layout(self.indent)[1:]
        name = f"part-{partition:07}-{uuid.uuid4().hex}"
        try:
            for batch in in_pieces(iterator, WRITTEN):
                texts = batch.column("json").to_pylist()
                if out is None:
                    store, at = files.opened(f"{self.folder}/{name}")
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at)
                # a line feed inside a string is escaped, so that every one here ends a line of the layout
                data = ((between if rows else "") + between.join(t.replace("\n", "\n" + pad) for t in texts)).encode()
                out.write(data)
                rows, size = rows + len(texts), size + len(data)
        finally:
            if out is not None:
                out.close()
        return _Part(partition, name if rows else None, rows, size)

    def commit(self, messages):
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        files.finish(self.folder, [m.name for m in parts], {"parts": [[m.name, m.rows, m.size] for m in parts], "rows": sum(m.rows for m in parts), "indent": self.indent})

    def abort(self, messages):
        files.delete(self.folder, [n for n in files.names(self.folder) if n.startswith("part-")])


def layout(indent: int | None) -> tuple[str, str, str]:
    """(after the bracket, before each line of an element, between elements), as json.dump() lays out a list."""
    pad = " " * indent if indent else ""
    return ("\n" + pad if indent else ""), pad, (",\n" + pad if indent else ", ")


class JsonArrays(DataSource):
    """See above. To read: path, and plan as read_array() makes it. To write: path of a folder, indent."""

    @classmethod
    def name(cls) -> str:
        return "weft_json_array"

    def schema(self) -> str:
        return "record_no bigint, json string"

    def reader(self, schema):
        return ArrayReader(self.options["path"], json.loads(self.options["plan"]))

    def writer(self, schema, overwrite):
        if schema.names != ["json"]:
            raise ValueError("the sink takes one column, json")
        return ArrayWriter(self.options["path"], int(self.options["indent"]) if self.options.get("indent") else None)


def is_array(path: str) -> bool:
    """Whether a file starts with a bracket."""
    store, at = files.opened(path)
    with store.open_input_stream(at) as source:
        while data := source.read(1 << 16):
            if rest := data.lstrip(WHITE):
                return rest[:1] == b"["
    return False


def read_array(spark: SparkSession, path: str, bytes_per_task: int = RANGE) -> DataFrame:
    """(record_no, json): the elements of the array that a file holds, numbered from 0, each as it stands in the file.

    Reads the file twice; the plan of its ranges, five numbers for each, comes from the driver. A file of more than RANGES
    ranges is cut into longer ones, of RANGE bytes at the most or as many as asked for. A file that is no
    array, or ends before its array does, is an error; what stands between the commas is not checked here.
    """
    spark.dataSource.register(JsonArrays)
    size = files.size(path)
    if size is None:
        raise FileNotFoundError(path)
    if not is_array(path):
        raise ValueError(f"{path} holds no JSON array")
    bytes_per_task = max(bytes_per_task, min(RANGE, -(-size // RANGES)))
    begins = list(range(0, size, bytes_per_task))
    ends = [*begins[1:], size]

    def scan(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                begin = number * bytes_per_task
                yield pa.RecordBatch.from_pydict({"id": [number], "found": [json.dumps(scan_range(path, begin, min(begin + bytes_per_task, size)))]})

    rows = spark.range(0, len(begins), 1, len(begins)).mapInArrow(scan, "id bigint, found string").collect()
    scanned = [json.loads(r["found"], object_hook=lambda d: {int(k) if k.lstrip("-").isdigit() else k: v for k, v in d.items()}) for r in sorted(rows, key=lambda r: r["id"])]
    plan = [(b, e, *state) for b, e, state in zip(begins, ends, compose(scanned), strict=True)]
    return spark.read.format("weft_json_array").option("plan", json.dumps(plan)).load(path)


def write_array(texts: DataFrame, path: str, order: str | None = "record_no", indent: int | None = 2) -> int:
    """One file with one JSON array of the column json in order, indented as json.dump() would; returns its rows.

    Without an order, rows stay as their partitions hold them. Tasks write parts beside the file, and one
    task streams them into it. An existing file is an error.
    """
    spark = texts.sparkSession
    spark.dataSource.register(JsonArrays)
    if files.size(path) is not None:
        raise FileExistsError(path)
    folder = f"{path}-parts-{uuid.uuid4().hex}"
    write = (texts.orderBy(order) if order else texts).select("json").write.format("weft_json_array").mode("append")

    def join(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"rows": [assemble(folder, path)]})

    try:
        (write.option("indent", indent) if indent else write).save(folder)
        return spark.range(0, 1, 1, 1).mapInArrow(join, "rows bigint").first()["rows"]
    finally:
        files.delete_folder(folder)


def assemble(folder: str, path: str) -> int:
    """Streams the parts that a folder's manifest names into one file, and moves it into place."""
    found = files.manifest(folder)
    head, _, between = layout(found["indent"])
    end = ("\n" if found["indent"] else "") + "]"
    store, at = files.opened(path)
    inner = files.opened(folder)[1]
    draft = f"{inner}/whole-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        if not found["rows"]:
            out.write(b"[]")
        for i, (name, _, _) in enumerate(found["parts"]):
            out.write((between if i else "[" + head).encode())
            with store.open_input_stream(f"{inner}/{name}") as source:
                while data := source.read(PIECE):
                    out.write(data)
        if found["rows"]:
            out.write(end.encode())
    store.move(draft, at)
    return found["rows"]
