"""Toxicity by classifier chains.

Categories are predicted one after another by linear models over words and word beginnings; each
later model also gets the earlier categories' log-odds. In training these come out of fold, from
models that did not see the document, so that a later model does not trust its predecessors more
than it can when it scores new documents.

The chain's categories come from the labels: first poor (quality 0), then toxic, whose model sees how
likely the document is poor; the last category is the verdict. Other chains can be passed.

Models are fitted on a bounded sample of labelled documents (POSITIVES and NEGATIVES of the last
category, by hash of the id), near copies in it left out so that one much-copied text does not rule, and
others drawn in their place; sampling weights restore the classes' shares. Scoring covers all documents, whole texts, in one pass without shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import blocks, cut, filtered, plain, table
from weftline.llm.linear import Sparse, fit_sparse, logit, sigmoid
from weftline.llm.words import KEEP, eight, hashes, lowered, mix, scan, spans

#: Labelled documents that the chain is fitted on at the most.
POSITIVES, NEGATIVES = 2500, 5000
#: How many times as many are looked at, so that others can take the place of near copies.
DRAWN = 2
#: Categories in order, as SQL over the labels' columns that gives 0, 1 or null.
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}
#: Words and word beginnings that the models use at the most for each category, and documents that must hold one.
FEATURES, LEAST_DOCS = 1024, 3
#: Least hashes that tell near copies, and how many of them such share.
SIGNS, SHARED = 16, 13
#: Lengths, in bytes, of word beginnings; eight at the most.
STEMS = (4, 5, 6, 7, 8)
FOLDS = 5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of every word and word beginning, and the texts' words: first[i] to first[i + 1]."""
    data, offsets = plain(texts)
    first, starts, ends = spans(data, offsets, "letters")
    low, lengths = lowered(data), ends - starts
    document = np.repeat(np.arange(len(texts)), np.diff(first))
    all_documents, all_hashes = [document], [hashes(low, starts, lengths)]
    begins = eight(low, starts) if len(starts) else np.empty(0, np.uint64)
    for n in STEMS:
        longer = np.flatnonzero(lengths > n)
        all_documents.append(document[longer])
        all_hashes.append(mix((begins[longer] & KEEP[n]) + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)))
    return np.concatenate(all_documents), np.concatenate(all_hashes), first


class Vocabulary:
    """Chosen features; finds those of a block of texts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, texts: pa.Array) -> Sparse:
        document, hashes, _ = features(texts)
        near = self.seen[(hashes >> np.uint64(44)).astype(np.int64)]
        document, hashes = document[near], hashes[near]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(document[hit] * len(self.hashes) + at[hit])
            document, at = np.divmod(pairs, len(self.hashes))
        else:
            document = at = np.empty(0, np.int64)
        return Sparse(at, np.searchsorted(document, np.arange(len(texts) + 1)), len(self.hashes))


class Chain:
    """Fitted models in order; predict() gives a column of probabilities for each category."""

    def __init__(self, names: list[str], vocabulary: Vocabulary, models: list[np.ndarray], threshold: float = 0.5):
        self.names, self.vocabulary, self.models, self.threshold = names, vocabulary, models, threshold

    def predict(self, texts: pa.Array) -> np.ndarray:
        x = self.vocabulary.find(texts)
        out = np.empty((len(texts), len(self.models)))
        for k, beta in enumerate(self.models):
            x.extra = _earlier(out[:, :k])
            out[:, k] = sigmoid(x.times(beta))
        return out


def _earlier(p: np.ndarray) -> np.ndarray:
    """Earlier categories as columns: log-odds, on the scale of a feature."""
    return np.clip(logit(p), -8, 8) / 8


def _fit_chain(x: Sparse, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Models for the columns of y, in order, and out-of-fold probabilities; a label that is not known weighs nothing."""
    out, models = np.zeros(y.shape), []
    for k in range(y.shape[1]):
        known = ~np.isnan(y[:, k])
        target, own = np.where(known, y[:, k], 0.0), weight * known
        x.extra = _earlier(out[:, :k])
        models.append(fit_sparse(x, target, own))
        for f in range(FOLDS):
            test = fold == f
            if test.any() and not test.all():
                beta = fit_sparse(x.take(np.flatnonzero(~test)), target[~test], own[~test])
                out[test, k] = sigmoid(x.take(np.flatnonzero(test)).times(beta))
            elif test.any():
                out[test, k] = sigmoid(x.times(models[k]))
    return models, out


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability that splits out-of-fold predictions with the best F1; halfway to its neighbour."""
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (taken + (weight * y).sum() + 1e-9)
    f1[:-1][np.diff(p[order]) == 0] = 0  # equal predictions go together
    best = int(np.argmax(f1)) if len(p) and y.any() else None
    if best is None:
        return 0.5
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip(sigmoid((logit(p[order][best]) + logit(np.array(below))) / 2), 0.05, 0.95))


def _signatures(first: np.ndarray, hashes: np.ndarray, n: int = SIGNS) -> np.ndarray:
    """Least hashes of each text's word triples under n mixings: near copies share them."""
    out = np.zeros((len(first) - 1, n), np.uint64)
    h = hashes.copy()
    h[:-2] = mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1] * np.uint64(5) + hashes[2:]))
    some = np.flatnonzero(np.diff(first))
    for k in range(n):
        if len(some):
            out[some, k] = np.minimum.reduceat(mix(h + np.uint64(k * 7919)), first[:-1][some])
    return out


def _apart(rows, most: dict[int, int]):
    """Ids of rows (id, target, signature) without near copies of earlier ones, so many of each target."""
    kept, holders, left = [], {}, dict(most)
    for i, target, *signs in rows:
        shared: dict[int, int] = {}
        for mark in enumerate(signs):
            for other in holders.get(mark, ()):
                shared[other] = shared.get(other, 0) + 1
        if left[target] > 0 and max(shared.values(), default=0) < SHARED:
            for mark in enumerate(signs):
                holders.setdefault(mark, []).append(len(kept))
            kept.append(i)
            left[target] -= 1
    return kept


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Chain:
    """A chain over categories, in order; the last is the verdict.

    Labels of documents that are not there teach nothing, nor do those without the last category; where
    another is null, 0 or 1 aside, or labels lack its columns, that category learns from the rest, or is left
    out. Of labels with one id the largest counts, of documents with one id the least text. Without
    labelled documents the chain finds nothing toxic.
    """
    spark = docs.sparkSession
    last = list(categories)[-1]
    has = {c: e for c, e in categories.items() if c == last or all(w in labels.columns for w in re.findall(r"[A-Za-z_]\w*", e))}
    names = list(has)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.when(F.expr(e).isin(0, 1), F.expr(e))).cast("int").alias(c) for c, e in has.items())).where(F.col(last).isNotNull())
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = cut(known.select("doc_id", F.struct(*names).alias("y"), F.col(last).alias("target")))
    sizes = {r[0]: r[1] for r in known.groupBy("target").count().collect()}
    most = {1: positives, 0: negatives}
    picked = None
    for value, n in most.items():
        part = known.where(F.col("target") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(DRAWN * n)
        picked = part if picked is None else picked.union(part)
    # at most DRAWN * (POSITIVES + NEGATIVES) ids
    sample = docs.select("doc_id", "text").join(F.broadcast(cut(picked)), "doc_id")
    sample = cut(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("target").alias("target")))
    marks = [f"s{k}" for k in range(SIGNS)]

    def sign(batches):
        for batch in blocks(batches):
            first, hashes, _, _ = scan(*plain(batch.column("text")), "letters")
            signs = _signatures(first, hashes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), *(pa.array(signs[:, k].view(np.int64)) for k in range(SIGNS))], ["doc_id", "target", *marks])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = sample.select("doc_id", "text", "target").mapInArrow(sign, f"doc_id {kind}, target int, " + ", ".join(f"{m} bigint" for m in marks))
    kept = _apart(map(tuple, signed.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator()), most)
    if not kept:
        return Chain(names, Vocabulary(np.empty(0, np.uint64)), [np.array([0.0] * k + [-20.0]) for k in range(len(names))])
    ids = spark.sparkContext.broadcast(set(kept))

    def rows(batches):
        for batch in blocks(batches):
            batch = batch.filter(pa.array([i in ids.value for i in batch.column("doc_id").to_pylist()]))
            if batch.num_rows:
                yield batch, np.array([[np.nan if v[c] is None else v[c] for c in names] for v in batch.column("y").to_pylist()])

    def count(batches):
        for batch, y in rows(batches):
            document, hashes, _ = features(batch.column("text"))
            order = np.lexsort((document, hashes))
            document, hashes = document[order], hashes[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
            document, hashes = document[new], hashes[new]
            begins = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
            if len(begins):
                sums = np.add.reduceat(np.hstack([np.ones((len(y), 1)), np.nan_to_num(y), ~np.isnan(y)])[document], begins, axis=0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[begins].view(np.int64)), *map(pa.array, sums.T)], ["hash", *counts])

    def vectors(batches):
        for batch, y in rows(batches):
            x = vocabulary.value.find(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(x.bounds, pa.int32()), pa.array(x.ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(y), pa.list_(pa.float64())), lists], ["doc_id", "y", "ids"])

    counts = ["n", *(f"p{k}" for k in range(len(names))), *(f"k{k}" for k in range(len(names)))]
    counted = cut(sample.mapInArrow(count, "hash bigint, " + ", ".join(f"{c} bigint" for c in counts)).groupBy("hash").agg(*(F.sum(c).alias(c) for c in counts)).where(F.col("n") >= LEAST_DOCS))
    label = {r[0]: r[1] for r in sample.select("doc_id", "y").where("doc_id is not null").toLocalIterator()}
    chosen = set()
    for k, c in enumerate(names):
        own = [label[i][c] for i in kept if label[i][c] is not None]
        p, n = sum(own), len(own)
        a, b = F.col(f"p{k}"), F.col(f"k{k}") - F.col(f"p{k}")
        z = F.abs(F.log((a + 0.5) / (F.lit(p + 0.5) - a + 0.5)) - F.log((b + 0.5) / (F.lit(n - p + 0.5) - b + 0.5))) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        chosen |= {r[0] for r in counted.orderBy(z.desc(), "hash").limit(FEATURES).select("hash").collect()}
    vocabulary = spark.sparkContext.broadcast(Vocabulary(np.array(sorted(chosen), np.int64).view(np.uint64)))
    found = sample.mapInArrow(vectors, f"doc_id {kind}, y array<double>, ids array<int>").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    y = np.array(found.column("y").to_pylist(), float)
    lists = found.column("ids").combine_chunks()
    x = Sparse(lists.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum([len(v) for v in lists.to_pylist()]))).astype(np.int64), len(vocabulary.value.hashes))
    target = y[:, -1]
    weight = np.where(target == 1, sizes.get(1, 0) / max(1, (target == 1).sum()), sizes.get(0, 0) / max(1, (target == 0).sum()))
    weight = weight / weight.mean()
    fold = np.arange(len(y)) % FOLDS  # rows are in hash order
    models, out = _fit_chain(x, y, weight, fold)
    return Chain(names, vocabulary.value, models, _threshold(out[:, -1], target, weight))


def score(docs: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, p_<category> of each, toxic): toxic if the last category's probability reaches the chain's threshold.

    Null and empty texts have the models' constant probability; repeated rows and null ids stay; an
    empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [id_column, *(f"p_{n}" for n in chain.names), "toxic"]

    def run(batches):
        for batch in blocks(batches, text_column):
            p = shared.value.predict(batch.column(text_column))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= shared.value.threshold)], names)

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, " + ", ".join(f"`p_{n}` double" for n in chain.names) + ", toxic boolean")


def remove(docs: DataFrame, chain: Chain, text_column: str = "text") -> DataFrame:
    """docs, all columns, without those whose last category's probability reaches the chain's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    return filtered(docs, lambda batch: shared.value.predict(batch.column("text"))[:, -1] < shared.value.threshold, text_column)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
