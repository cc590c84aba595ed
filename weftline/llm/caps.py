"""Embedding near-duplicates with spherical-cap filters under random product codes.

A filter is a direction of the sphere; it takes the vectors whose inner product with it exceeds a
threshold, a spherical cap. The directions form a structured code: the space, randomly rotated, is
cut into two halves with a random codebook for each, and every pair of codewords is a filter. So a
vector is list-decoded to all filters that it exceeds from two short lists of inner products,
without looking at each filter. Vectors that share a filter are compared exactly, in double
precision; a link is counted at the first filter that both share, so counts need no list of pairs.

Rows are shuffled by the first codeword, once for each codeword in a vector's list, and decoded
again where they arrive. A codeword with more than CHUNK vectors is dealt out in chunks, each pair
of chunks to its own task; no group is gathered whole. Tasks return counts and a spanning forest.
Equal vectors are one class beforehand.

The threshold is set on a bounded sample (SAMPLE vectors, each with a simulated neighbour at exactly
the wanted cosine) so that such pairs share a filter with a chance of RECALL; closer ones do more
often. All vectors are then decoded and compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import components, cut, join_unique, table

COSINE = 0.95
RECALL = 0.9995
SAMPLE = 4000
CHUNK = 8192
#: Codewords of each half: about the square root of the vectors, so that caps keep their size up to 268 million.
LEAST_WORDS, MOST_WORDS = 16, 16384


class Code:
    """A product code with its threshold."""

    def __init__(self, dimension: int, words: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dimension, self.width = dimension, max(8, dimension + dimension % 2)
        self.rotation = np.linalg.qr(rng.normal(size=(self.width, self.width)))[0]
        books = rng.normal(size=(2, words, self.width // 2))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True) / math.sqrt(2)
        self.words, self.threshold = words, 0.0

    def products(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of unit vectors with the codewords of either half."""
        turned = np.zeros((len(unit), self.width))
        turned[:, : self.dimension] = unit
        turned = turned @ self.rotation
        half = self.width // 2
        return turned[:, :half] @ self.books[0].T, turned[:, half:] @ self.books[1].T

    def fit(self, unit: np.ndarray, cosine: float, recall: float, seed: int = 12) -> Code:
        rng = np.random.default_rng(seed)
        noise = rng.normal(size=unit.shape)
        noise -= (noise * unit).sum(1, keepdims=True) * unit
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        near = cosine * unit + math.sqrt(1 - cosine**2) * np.divide(noise, length, out=np.zeros_like(noise), where=length > 1e-9)
        near /= np.linalg.norm(near, axis=1, keepdims=True)
        top = min(self.words, 64)  # the best shared filter has a high codeword in each half
        best = np.empty(len(unit))
        for begin in range(0, len(unit), 256):
            (a, b), (c, d) = self.products(unit[begin : begin + 256]), self.products(near[begin : begin + 256])
            for k in range(len(a)):
                i, j = np.argpartition(-(a[k] + c[k]), top - 1)[:top], np.argpartition(-(b[k] + d[k]), top - 1)[:top]
                best[begin + k] = np.minimum(a[k, i][:, None] + b[k, j], c[k, i][:, None] + d[k, j]).max()
        self.threshold = float(np.quantile(best, 1 - recall, method="lower")) if len(best) else 0.0
        return self

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The numbers of all filters that each vector exceeds, ascending."""
        found = []
        for begin in range(0, len(unit), 256):
            a, b = self.products(unit[begin : begin + 256])
            index, first = np.nonzero(a + b.max(axis=1)[:, None] >= self.threshold)
            rows, second = np.nonzero(a[index, first][:, None] + b[index] >= self.threshold)
            filters = first[rows] * self.words + second
            found += np.split(filters, np.searchsorted(index[rows], np.arange(1, len(a))))
        return found

    def seconds(self, unit: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, second) of the filters with this first codeword."""
        found = []
        for begin in range(0, len(unit), 2048):
            a, b = self.products(unit[begin : begin + 2048])
            index, second = np.nonzero(a[:, first, None] + b >= self.threshold)
            found.append((index + begin, second))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def firsts(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, first) of the first codewords in each vector's list."""
        a, b = self.products(unit)
        return np.nonzero(a + b.max(axis=1)[:, None] >= self.threshold)


def _raw(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _unit(raw: np.ndarray) -> np.ndarray:
    flat = raw.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        while (label != label[label]).any():
            label = label[label]
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


def _compare(code: Code, first: int, unit: np.ndarray, weight: np.ndarray, side: np.ndarray | None, cosine: float):
    """Links among vectors that have this first codeword: (weight linked to each, forest labels).

    side: chunk of each vector if only pairs between two chunks are wanted.
    """
    index, seconds = code.seconds(unit, first)
    order = np.argsort(seconds, kind="stable")
    index, seconds = index[order], seconds[order]
    label = np.arange(len(unit))
    linked = np.zeros(len(unit), np.int64)
    lists: dict[int, np.ndarray] = {}  # filters of the vectors that have links
    bounds = np.searchsorted(seconds, np.arange(code.words + 1))
    for second in range(code.words):
        members = index[bounds[second] : bounds[second + 1]]
        if len(members) < 2 or side is not None and (side[members] == side[members[0]]).all():
            continue
        rows = members if side is None else members[~side[members]]
        others = members if side is None else members[side[members]]
        for begin in range(0, len(rows), 1024):
            part = rows[begin : begin + 1024]
            close = unit[part] @ unit[others].T >= cosine
            if side is None:
                close &= part[:, None] != others[None, :]
            if not close.any():
                continue
            keep_r, keep_o = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
            close, p, o = close[np.ix_(keep_r, keep_o)], part[keep_r], others[keep_o]
            # counted already where an earlier filter is shared
            used = np.unique(np.concatenate((p, o)))
            new = [u for u in used.tolist() if u not in lists]
            if new:
                lists.update(zip(new, code.decode(unit[new]), strict=True))
            own = first * code.words + second
            mine = [lists[u][: np.searchsorted(lists[u], own)] for u in used.tolist()]
            names, column = np.unique(np.concatenate(mine), return_inverse=True)
            if len(names):
                has = np.zeros((len(used), len(names)), np.float32)
                has[np.repeat(np.arange(len(used)), [len(m) for m in mine]), column] = 1
                shared = has[np.searchsorted(used, p)] @ has[np.searchsorted(used, o)].T > 0
                close &= ~shared
            linked[p] += close @ weight[o]
            if side is not None:
                linked[o] += close.T @ weight[p]
            a, b = np.nonzero(close)
            if len(a):
                # a spanning forest suffices for components; earlier filters give the rest
                label = _join(label, p[a], o[b])
    return linked, label


def _join(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    left, right = label[left], label[right]
    return _forest(len(label), left, right)[label]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, chunk: int = CHUNK, words: int | None = None) -> DataFrame:
    """(id, n_links, component_id) of every vector.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows whose id is
    null, link with nothing; vectors of different lengths are not compared. Rows with the same vector
    link with each other, whatever their ids; rows with the same id and different vectors are told
    apart, each with its own links and component; an empty table gives an empty result; other columns
    are ignored.
    """
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    given = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    fit = given.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    # an id may stand for several vectors, so that a class has a number of its own
    classes = cut(fit.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    # a vector that is the only one of its length links with nothing
    sizes = [r[0] for r in classes.groupBy(F.size("v")).count().where("count > 1").collect()]
    found = [_links(classes.where(F.size("v") == size), size, cosine, recall, sample, chunk, words) for size in sorted(sizes)]
    links = found[0] if found else classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("weight").alias("n")).limit(0)
    for more in found[1:]:
        links = links.union(more)
    links = cut(links.groupBy("a", "b").agg(F.sum("n").alias("n")))
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    joined = components(links.select("a", "b")).select(F.col("node").alias("rep"), "root")
    placed = cut(classes.join(counts, "rep", "left").join(joined, "rep", "left").select("v", "least", (F.coalesce("more", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    # a component may hold very many classes
    by_class = join_unique(placed, cut(placed.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("v", "n_links", "component_id")
    known = join_unique(cut(fit), cut(by_class), "v").select("id", "n_links", "component_id")
    rest = given.where(F.col("id").isNull() | F.col("v").isNull() | F.coalesce(bad, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return known.union(rest).withColumnRenamed("id", id_column)


def _links(classes: DataFrame, dimension: int, cosine: float, recall: float, sample: int, chunk: int, words: int | None) -> DataFrame:
    """(a, b, n): n is the weight linked directly to a, summed over rows; a and b are in one component."""
    spark = classes.sparkSession
    n = classes.count()
    if words is None:
        words = min(MOST_WORDS, max(LEAST_WORDS, 2 ** round(math.log2(max(1, n)) / 2)))
    # a bounded sample, by hash, fits the threshold
    share = max(1, math.ceil(1_000_000 * min(1.0, sample / max(n, 1))))
    chosen = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < share).limit(sample).select("v").toArrow().column("v").combine_chunks()
    code = spark.sparkContext.broadcast(Code(dimension, words).fit(_unit(_raw(chosen, dimension)), cosine, recall))
    kind = np.float32 if classes.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def units(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                raw = _raw(part.column("v"), dimension).astype(kind)
                yield part, raw, _unit(raw)

    def count(batches):
        total = np.zeros(code.value.words, np.int64)
        for _, _, unit in units(batches):
            total += np.bincount(code.value.firsts(unit)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["first", "n"])

    # at most MOST_WORDS rows
    sizes = np.zeros(words, np.int64)
    for row in classes.select("v").mapInArrow(count, "first bigint, n bigint").groupBy("first").agg(F.sum("n")).collect():
        sizes[row[0]] = row[1]
    chunks = np.maximum(1, -(-sizes // chunk))

    def route(batches):
        for part, raw, unit in units(batches):
            rep = part.column("rep").to_numpy()
            index, first = code.value.firsts(unit)
            mine = (rep[index].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[first]
            times = chunks[first]
            rows = np.repeat(np.arange(len(index)), times)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            low, high = np.minimum(mine[rows], other), np.maximum(mine[rows], other)
            for begin in range(0, len(rows), 8192):
                at = slice(begin, begin + 8192)
                take = pa.array(index[rows[at]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[rows[at]]), pa.array(low[at]), pa.array(high[at]), pa.array(mine[rows[at]] == high[at]), part.column("rep").take(take), part.column("weight").take(take), pa.array([x.tobytes() for x in raw[index[rows[at]]]], pa.binary())],
                    ["first", "low", "high", "upper", "rep", "weight", "raw"],
                )

    def compare(group: pa.Table) -> pa.Table:
        first, low, high = (group.column(c)[0].as_py() for c in ("first", "low", "high"))
        unit = _unit(np.frombuffer(b"".join(group.column("raw").to_pylist()), kind).reshape(-1, dimension))
        rep = group.column("rep").to_numpy()
        linked, label = _compare(code.value, first, unit, group.column("weight").to_numpy(), group.column("upper").to_numpy() if low != high else None, cosine)
        some = (linked > 0) | (label != np.arange(len(label)))
        return pa.table({"a": rep[some], "b": rep[label[some]], "n": linked[some]})

    routed = classes.select("rep", "weight", "v").mapInArrow(route, "first bigint, low bigint, high bigint, upper boolean, rep bigint, weight bigint, raw binary")
    return routed.groupBy("first", "low", "high").applyInArrow(compare, "a bigint, b bigint, n bigint")


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: All pairs are compared, which suits a table of some thousand vectors.
ORACLE = f"""with recursive given as (select row_number() over () as r, vec_id, cast(embedding as double[]) as v from embeddings),
 fit as (select r, vec_id, v from given where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
 links as (select a.r as a, b.r as b, b.vec_id from fit a join fit b on a.r <> b.r and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= {COSINE}),
 reach as (select r as a, r as b from fit union select reach.a, links.b from reach join links on links.a = reach.b),
 least as (select reach.a as r, min(fit.vec_id) as component_id from reach join fit on fit.r = reach.b group by reach.a)
 select vec_id, (select count(*) from links where links.a = given.r) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept from given left join least on least.r = given.r"""
