"""SimHash near-duplicates, found exactly with vantage-point trees over Hamming distance.

Equal fingerprints are one class. Two fingerprints within RADIUS bits differ in at most RADIUS // 2
bits in the upper or the lower half, so there is one vantage-point tree for each half: it splits the
fingerprints at the median distance, on that half, from a vantage point, level by level, and its
leaves are the shards. Each fingerprint lives in one leaf of each tree and is looked up in every
leaf that its ball reaches: the triangle inequality prunes a branch if the distance to the vantage
point lies further than the radius beyond the split, and only balls over a boundary visit both
sides. Within a leaf members are sorted by distance from another vantage point, which bounds the
window to compare bit by bit on all 64 bits.

The trees are fitted on a bounded sample (SAMPLE fingerprints, a million at the most), which decides
balance only, never results. Leaves with more than CHUNK members (copies cluster) are dealt to several tasks, as are
their look-ups, so no leaf is gathered whole. A task returns a spanning forest of the links it
finds, not all pairs; a distributed component search joins the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.llm.common import blocks, column, components, cut, join_unique, packed, table

RADIUS = 3
SHINGLE = 3
#: Distinct fingerprints that the trees are fitted on, or so many for each leaf where that is more.
SAMPLE, SAMPLE_LEAF = 1 << 16, 8
#: Members that a leaf should have, members and look-ups that one task takes from it at the most.
LEAF, CHUNK, CHUNK_QUERIES = 512, 4096, 16384
#: Leaves are LEAF members each up to 2**MOST_LEVELS * LEAF = 67 million fingerprints; beyond, leaves grow and are dealt out.
MOST_LEVELS = 17
HALVES = (0xFFFFFFFF, 0xFFFFFFFF << 32)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over the word shingles of a text, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(SHINGLE)), strict=False)]
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[begin : begin + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp bigint): the fingerprint of every text, as the signed number of the same bits."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in blocks(batches, text_column):
            fps = np.array([fingerprint(t) for t in batch.column(text_column).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(fps)], [id_column, "fp"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, fp bigint")


class Tree:
    """A complete binary vantage-point tree on the bits of a mask; node i has children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, mask: int, levels: int, radius: int, seed: int = 7):
        self.mask, self.levels, self.radius = np.uint64(mask), levels, radius
        self.points, self.splits = np.zeros(2**levels - 1, np.uint64), np.full(2**levels - 1, 16)
        rng = np.random.default_rng(seed)
        parts = {0: sample}
        for node in range(2**levels - 1):
            part = parts.pop(node)
            if len(part):
                best = None
                for point in rng.choice(part, min(4, len(part)), replace=False):
                    d = self.distance(part, point)
                    # few on the boundary, and halves of like size
                    split = int(np.median(d))
                    cost = np.mean((d > split - radius) & (d <= split + radius)) + abs(np.mean(d <= split) - 0.5)
                    if best is None or cost < best[0]:
                        best = cost, point, split, d
                _, self.points[node], self.splits[node], d = best
                inner, outer = part[d <= best[2]], part[d > best[2]]
            else:
                inner = outer = part
            parts[2 * node + 1], parts[2 * node + 2] = inner, outer

    def distance(self, a: np.ndarray, b) -> np.ndarray:
        return np.bitwise_count((a ^ b) & self.mask).astype(np.int64)

    def homes(self, fps: np.ndarray) -> np.ndarray:
        """The leaf in which each fingerprint lives."""
        node = np.zeros(len(fps), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (self.distance(fps, self.points[node]) > self.splits[node])
        return node - (2**self.levels - 1)

    def reach(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of every leaf that the ball around each fingerprint reaches."""
        index, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.levels):
            d, split = self.distance(fps[index], self.points[node]), self.splits[node]
            inner, outer = d - self.radius <= split, d + self.radius > split
            index = np.concatenate((index[inner], index[outer]))
            node = np.concatenate((2 * node[inner] + 1, 2 * node[outer] + 2))
        return index, node - (2**self.levels - 1)


def _mixed(fps: np.ndarray) -> np.ndarray:
    return (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _forest(members: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint linked to it here): links between queries and members, as a spanning forest."""
    nodes = np.union1d(members, queries)
    label = np.arange(len(nodes))
    point = members[0]
    far = np.bitwise_count(members ^ point)
    order = np.argsort(far, kind="stable")
    members, far = members[order], far[order]
    at_m, at_q = np.searchsorted(nodes, members), np.searchsorted(nodes, queries)
    away = np.bitwise_count(queries ^ point).astype(np.int64)
    for d in np.unique(away):
        low, high = np.searchsorted(far, max(0, d - radius)), np.searchsorted(far, d + radius, "right")
        if low == high:
            continue
        window, where = members[low:high], np.flatnonzero(away == d)
        step = max(1, (1 << 21) // (high - low))
        for begin in range(0, len(where), step):
            part = where[begin : begin + step]
            q, m = np.nonzero(np.bitwise_count(queries[part][:, None] ^ window[None, :]) <= radius)
            a, b = at_q[part[q]], at_m[low + m]
            a, b = a[a != b], b[a != b]
            while len(a):
                least = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], least)
                np.minimum.at(label, label[b], least)
                while (label != label[label]).any():
                    label = label[label]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(classes: DataFrame, radius: int = RADIUS, leaf: int = LEAF, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links that span the components of all pairs of distinct fingerprints within the radius.

    classes has one column, fp, distinct and not null.
    """
    spark = classes.sparkSession
    n = classes.count()
    levels = min(MOST_LEVELS, max(0, (max(n, 1) - 1) // leaf).bit_length())
    sample = max(sample, SAMPLE_LEAF << levels)
    share = min(1.0, sample / max(n, 1))
    chosen = classes.where((F.xxhash64("fp") % 1_000_000 + 1_000_000) % 1_000_000 < int(share * 1_000_000) + 1).limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    forest = spark.sparkContext.broadcast([Tree(np.sort(chosen), half, levels, radius // 2) for half in HALVES])

    def each(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for begin in range(0, len(fps), 8192):
                part = fps[begin : begin + 8192]
                for number, tree in enumerate(forest.value):
                    home = tree.homes(part)
                    index, at = tree.reach(part)
                    yield part[index], at + (number << 32), at == home[index]

    def count(batches):
        for _, at, member in each(batches):
            leaves, inverse = np.unique(at, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(np.bincount(inverse, member).astype(np.int64)), pa.array(np.bincount(inverse))], ["leaf", "members", "queries"])

    sizes = classes.mapInArrow(count, "leaf bigint, members bigint, queries bigint").groupBy("leaf").agg(F.sum("members").alias("m"), F.sum("queries").alias("q"))
    # fewer rows than leaves, which are 2 * 2**MOST_LEVELS at the most
    dealt = {r[0]: (-(-r[1] // chunk), -(-r[2] // CHUNK_QUERIES)) for r in sizes.where((F.col("m") > chunk) | (F.col("q") > CHUNK_QUERIES)).collect()}

    def route(batches):
        for fps, at, member in each(batches):
            m_of, q_of = np.ones(len(fps), np.int64), np.ones(len(fps), np.int64)
            for big in np.intersect1d(np.fromiter(dealt, np.int64, len(dealt)), at):
                m_of[at == big], q_of[at == big] = dealt[int(big)]
            salt = _mixed(fps).astype(np.int64)
            # a look-up goes to all chunks of members, a member to all chunks of look-ups
            for role, own, other in ((False, q_of, m_of), (True, m_of, q_of)):
                keep = np.flatnonzero(member) if role else np.arange(len(fps))
                times = np.maximum(other[keep], 1)
                rows = np.repeat(keep, times)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                mine = salt[rows] % np.maximum(own[rows], 1)
                task = (mine << 20 | nth) if role else (nth << 20 | mine)
                yield pa.RecordBatch.from_arrays([pa.array(at[rows]), pa.array(task), pa.array(fps[rows].view(np.int64)), pa.array(np.full(len(rows), role))], ["leaf", "task", "fp", "member"])

    def search(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        member = group.column("member").to_numpy()
        members, queries = np.unique(fps[member]), np.unique(fps[~member])
        if not len(members) or not len(queries):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = _forest(members, queries, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = classes.mapInArrow(route, "leaf bigint, task bigint, fp bigint, member boolean")
    return routed.groupBy("leaf", "task").applyInArrow(search, "a bigint, b bigint")


def _grouped(docs: DataFrame, id_column: str, text_column: str, radius: int) -> DataFrame:
    """(id, fp, root, component_id) of every document: root tells components apart, also those that share an id."""
    fps = cut(fingerprints(docs, id_column, text_column))
    classes = cut(fps.groupBy("fp").agg(F.min(id_column).alias("least")))
    joined = components(links(classes.select("fp"), radius))
    roots = cut(classes.join(joined, F.col("fp") == F.col("node")).select("fp", "root", "least"))
    best = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    # a component may hold very many fingerprints, and a fingerprint very many documents
    linked = join_unique(roots, best, "root").select("fp", "root", "component_id")
    of = cut(classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")))
    return join_unique(fps, of, "fp").select(id_column, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): every document, with the smallest id reachable by links.

    Texts without words (null and empty ones too) have fingerprint 0 and link like any other. Repeated
    rows and ids stay, each in its component; null ids stay and are never a component's id unless it
    has no other; an empty table gives an empty one; other columns are ignored.
    """
    return _grouped(docs, id_column, text_column, radius).select(id_column, "fp", "component_id")


#: Dropped ids that may be broadcast; 16 bytes each, so at most 32 MB.
BROADCAST_IDS = 2_000_000


def _marked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(weft_row, id, fp): the rows of docs as structs, with their ids and fingerprints."""

    def run(batches):
        for batch in blocks(batches):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("weft_row"), batch.column("id"), pa.array(fps)], ["weft_row", "id", "fp"])

    rows = packed(docs, id=column(id_column), text=column(text_column))
    return rows.mapInArrow(run, StructType([rows.schema["weft_row"], rows.schema["id"], StructField("fp", LongType())]))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, all columns, with one document of each group: the one with the smallest id.

    Rows with a null id stay; of rows with the same id and group one stays. Rows with the same id in
    different groups are judged each in its own. Columns may have any names. Cases as in near_duplicates().
    """
    pairs = docs.select(column(id_column).alias("id"), column(text_column).alias("text"))
    named = cut(_grouped(pairs, "id", "text", RADIUS).where(F.col("id").isNotNull()))
    counts = named.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count(F.when(F.col("id") != F.col("component_id"), 1)).alias("out")).first()
    small = lambda rows, n: F.broadcast(rows) if n <= BROADCAST_IDS else rows
    if counts["n"] == counts["ids"]:
        dropped = named.where(F.col("id") != F.col("component_id")).select("id")
        return packed(docs, id=column(id_column)).join(small(dropped, counts["out"]), "id", "left_anti").select("weft_row.*")
    # an id may stand for several texts: a row is told by its id and fingerprint, and a group keeps one such pair
    kept = named.where(F.col("id") == F.col("component_id")).groupBy("id", "root").agg(F.min("fp").alias("fp"))
    dropped = cut(named.select("id", "fp").distinct().join(kept, ["id", "fp"], "left_anti"))
    keys = ["id", "fp"]
    rows = _marked(docs, id_column, text_column)
    judged = rows.where(F.col("id").isNotNull()).join(small(dropped, dropped.count()), keys, "left_anti").dropDuplicates(keys)
    return judged.select("weft_row.*").union(docs.where(column(id_column).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
