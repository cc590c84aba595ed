"""Quality classifier by co-training of two views.

One classifier sees a document's content (characters, repetition, shapes of words and lines), the
other its metadata (source, language, stated length). Both start from the labelled documents. Round
after round each scores all other documents and hands those that it is most sure of, with its verdict as
label, to the other, so each learns from what only the other view shows; a view hands over only what
its calibrated probability makes at least CONFIDENT, if that held for labels that it did not see, so a weak
view keeps silent, and of documents that
look the same to both views one. Both are calibrated on labelled documents held out of training in turn, and a
small model of the two calibrated log-odds, fitted there too, gives the score of every document.

The labels are a bounded sample (LABELLED documents, by hash of the id), and HANDED bounds what a view
hands over; all documents are scored in every round, from a table of their views' numbers. Scoring covers
all documents, whole texts, in one pass without shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import blocks, cut, delete, filtered, plain, table, written
from weftline.llm.linear import fit_dense, logit, predict_dense, sigmoid
from weftline.llm.words import mix, scan

#: Labelled documents that the views are trained on at the most; others count as unlabelled.
LABELLED = 8000
#: Rounds, pseudo-labels that a view hands over in a round, and how sure it must be.
ROUNDS, HANDED, CONFIDENT = 4, 1000, 0.97
#: A view hands over a verdict only if, of labels that it did not see and was as sure of, so few (one more counted)
#: were wrong, and half as many as without looking.
MOST_ERROR = 0.1
#: Tasks that the surest documents come together in before they go to the driver.
MERGERS = 4
#: A pseudo-label's weight beside a label's.
PSEUDO = 0.3
#: Parts of the labelled documents: each is held out of views that calibration is fitted on.
FOLDS = 4
THRESHOLD = 0.5
SOURCES, LANGUAGES, LENGTHS = 32, 8, 24
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]


def content(texts: pa.Array) -> np.ndarray:
    """The content view: a row of numbers for each text."""
    data, offsets = plain(texts)
    n = len(texts)
    sizes = np.diff(offsets)
    document = np.repeat(np.arange(n), sizes)
    bytes_ = np.bincount(document * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(sizes, 1)[:, None]
    lower, upper, digits = (bytes_[:, a:b].sum(1, keepdims=True) for a, b in ((97, 123), (65, 91), (48, 58)))
    first, hashes, starts, ends = scan(data, offsets, "spaced")
    words = np.diff(first)
    most = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)

    def share(mask, where):
        return np.bincount(where, mask, n) / most

    repeats = []
    for lag in (1, 2, 3):
        same = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
        repeats.append(share(same, owner[lag:]))
    if len(hashes):
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = share(new, owner[order])
        pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        inside = owner[1:] == owner[:-1]
        order = np.lexsort((pairs[inside], owner[1:][inside]))
        pairs, of = pairs[inside][order], owner[1:][inside][order]
        again = np.zeros(len(pairs), bool)
        again[1:] = (pairs[1:] == pairs[:-1]) & (of[1:] == of[:-1])
        twice = share(again, of)
    else:
        distinct = twice = np.zeros(n)
    length = ends - starts
    mean = share(length, owner)
    spread = np.sqrt(np.maximum(share(length.astype(float) ** 2, owner) - mean**2, 0))
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    sign = (last > 32) & (last < 127) & ~((last >= 48) & (last <= 57)) & ~((last >= 65) & (last <= 90)) & ~((last >= 97) & (last <= 122))
    ordinary = np.isin(last, np.frombuffer(b".,;:?!\"')", np.uint8))
    double = sign & (length > 1)
    double[double] = data[ends[double] - 2] == last[double]
    single = length == 1
    lines = bytes_[:, 10] + 1
    logs = np.log1p(np.stack([words, sizes, sizes / lines, words / lines], axis=1))
    shares = np.hstack([bytes_[:, PUNCTUATION], upper, digits, bytes_[:, 128:].sum(1, keepdims=True), bytes_[:, [10]], bytes_[:, [32]], bytes_[:, :9].sum(1, keepdims=True)]) / total
    return np.column_stack(
        [np.sqrt(shares), (upper / np.maximum(upper + lower, 1)).ravel(), *map(np.sqrt, repeats), distinct, np.sqrt(twice), mean / 10, spread / 10, *(np.sqrt(share(m, owner)) for m in (sign & ~ordinary, ordinary, double, single)), logs / 5, words == 0]
    )


def metadata(source: list, lang: list, n_chars: list) -> np.ndarray:
    """The metadata view: one column each for a source's and a language's hash and for a stated length's size; null has its own."""
    out = np.zeros((len(source), SOURCES + LANGUAGES + LENGTHS))
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, 0 if s is None else 1 + zlib.crc32(str(s).encode("utf-8", "replace")) % (SOURCES - 1)] = 1
        out[i, SOURCES + (0 if g is None else 1 + zlib.crc32(str(g).encode("utf-8", "replace")) % (LANGUAGES - 1))] = 1
        out[i, SOURCES + LANGUAGES + (0 if n is None or n < 0 else min(LENGTHS - 1, 1 + int(n).bit_length()))] = 1
    return out


class View:
    """A standardised logistic model with its calibration."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        self.beta = fit_dense(self._standard(x), y, weight, l2=2.0)
        self.line, self.says = np.array([1.0, 0.0]), {}
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return logit(predict_dense(self._standard(x), self.beta))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(raw * self.line[0] + self.line[1], -12, 12)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return self.calibrated(self.raw(x))


class CoTrained:
    """Two calibrated views and how they combine."""

    def __init__(self, views: list[View], combination: np.ndarray):
        self.views, self.combination = views, combination

    def predict(self, texts: pa.Array, source: list, lang: list, n_chars: list) -> np.ndarray:
        x = (content(texts), metadata(source, lang, n_chars))
        odds = np.column_stack([v.log_odds(a) for v, a in zip(self.views, x, strict=True)])
        return predict_dense(odds, self.combination)


def most_sure(views: list[View], x: list[np.ndarray], keys: np.ndarray, taken: list[set], most: dict[float, int]) -> list[tuple]:
    """(receiving view, verdict, how sure, key, row) of what each view would hand to the other.

    keys tell documents apart that look different to a view; one of each, and none that the receiver was
    handed before (taken), the surest first.
    """
    found = []
    if not len(keys):
        return found
    for k, other in ((0, 1), (1, 0)):
        p = sigmoid(views[k].log_odds(x[k]))
        for verdict, sure in ((1.0, p), (0.0, 1 - p)):
            at = np.flatnonzero((sure >= CONFIDENT) & views[k].says[verdict])
            at = at[np.lexsort((keys[at], -sure[at]))]
            mine: set = set()
            for i in at.tolist():
                if keys[i] not in taken[other] and keys[i] not in mine:
                    mine.add(int(keys[i]))
                    found.append((other, verdict, float(sure[i]), int(keys[i]), i))
                    if len(mine) == most[verdict]:
                        break
    return found


def _of_arrays(pool: list[np.ndarray]):
    keys = np.arange(len(pool[0]))
    return lambda views, taken, most: [(other, verdict, sure, key, pool[other][i]) for other, verdict, sure, key, i in most_sure(views, pool, keys, taken, most)]


def co_train(x: list[np.ndarray], y: np.ndarray, pool, rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained:
    """x: the two views of labelled documents, in an order that is independent of the labels.

    pool: the two views of unlabelled ones, or a function of the views, of the keys that each was handed
    before and of how many of each verdict are wanted, in the labels' proportion, which returns (receiving view, verdict, how sure, key, numbers of the receiving view).
    """
    fold = np.arange(len(y)) % FOLDS
    share = y.mean()
    most = {1.0: max(1, round(handed * share)), 0.0: max(1, round(handed * (1 - share)))}
    ask = pool if callable(pool) else _of_arrays(pool)
    got: list[list] = [[], []]  # (verdict, numbers) that each view was handed
    taken: list[set] = [set(), set()]

    def train(k):
        """A view, and the calibrated log-odds of labelled documents by views that did not see them."""
        more = np.array([v for _, v in got[k]]).reshape(len(got[k]), x[k].shape[1])
        verdicts = np.array([v for v, _ in got[k]])

        def fit(rows):
            return View().fit(np.vstack([x[k][rows], more]), np.concatenate([y[rows], verdicts]), np.concatenate([np.ones(rows.sum()), np.full(len(more), PSEUDO)]))

        view, raw = fit(fold >= 0), np.zeros(len(y))
        for f in range(FOLDS):
            rest = fold != f
            if rest.any() and not rest.all():
                raw[~rest] = fit(rest).raw(x[k][~rest])
            elif not rest.all():
                raw = view.raw(x[k])
        view.line = fit_dense(raw[:, None], y, l2=1e-2)
        # a view that errs on labels that it did not see, more often than not, says nothing
        view.line[0] = max(view.line[0], 0.0)
        odds = view.calibrated(raw)
        for verdict, sure in ((1.0, sigmoid(odds)), (0.0, sigmoid(-odds))):
            at = sure >= CONFIDENT
            error, guess = ((y[at] != verdict).sum() + 1) / (at.sum() + 2), (y != verdict).mean()
            view.says[verdict] = bool(error <= min(MOST_ERROR, guess / 2))
        return view, odds

    trained = [train(k) for k in range(2)]
    for _ in range(rounds):
        for other, verdict, _, key, numbers in ask([v for v, _ in trained], taken, most):
            if key not in taken[other]:  # sure of both verdicts it can not be, but equal keys come once
                taken[other].add(key)
                got[other].append((verdict, numbers))
        trained = [train(k) for k in range(2)]
    combination = fit_dense(np.column_stack([odds for _, odds in trained]), y, l2=1.0)
    combination[:2] = np.maximum(combination[:2], 0)  # a calibrated view never counts against itself
    return CoTrained([v for v, _ in trained], combination)


def _meta(docs: DataFrame) -> list:
    """source, lang and n_chars, null where docs lacks them."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "bigint"))]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained:
    """A classifier from labels (doc_id, quality 0 or 1); other values and nulls teach nothing.

    Of labels with one id the largest counts, of labelled documents with one id the one whose numbers come first.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    # at most LABELLED ids
    picked = cut(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    rows = docs.select("doc_id", "text", *_meta(docs)).join(F.broadcast(picked), "doc_id", "left")

    def views(batches):
        for batch in blocks(batches):
            a = content(batch.column("text"))
            b = metadata(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            a, b = ([r.astype(np.float32).tobytes() for r in v] for v in (a, b))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "y", "a", "b"])

    widths = content(pa.array(["", "x"])).shape[1], SOURCES + LANGUAGES + LENGTHS
    array = lambda lists, k: np.frombuffer(b"".join(lists), np.float32).reshape(-1, widths[k]).astype(float)
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen, folder = written(rows.mapInArrow(views, f"doc_id {kind}, y double, a binary, b binary"))
    found = seen.where("y is not null").groupBy("doc_id").agg(F.min(F.struct("a", "b", "y")).alias("v")).orderBy(F.xxhash64("doc_id"), "doc_id").select("v.*").toArrow()
    y = found.column("y").to_numpy()
    if not len(y):
        # without labels everything is kept
        delete(spark, folder)
        return CoTrained([View().fit(np.zeros((1, w)), np.ones(1), np.ones(1)) for w in widths], np.array([0.0, 0.0, 5.0]))
    pool = seen.where("y is null").select(F.xxhash64("a", "b").alias("key"), "a", "b")

    sure = "view int, verdict double, sure double, key bigint, numbers binary"

    def ask(views, taken, most):
        shared = spark.sparkContext.broadcast((views, taken))

        def surest(batches):
            best: list[tuple] = []
            for batch in batches:
                for begin in range(0, batch.num_rows, 4096):
                    part = batch.slice(begin, 4096)
                    lists = [part.column(c).to_pylist() for c in ("a", "b")]
                    best += [(o, v, s, k, lists[o][i]) for o, v, s, k, i in most_sure(shared.value[0], [array(x, n) for n, x in enumerate(lists)], part.column("key").to_numpy(), shared.value[1], most)]
                best = _first(best, most)
            yield _rows(best)

        def merge(batches):
            yield _rows(_first([r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in SURE.names), strict=True)], most))

        # at most HANDED rows of each view from a task; merged in tasks of two levels, so that few reach the driver
        rows = pool.mapInArrow(surest, sure).dropDuplicates(["view", "verdict", "key"]).mapInArrow(merge, sure)
        best = rows.repartition(MERGERS).mapInArrow(merge, sure).collect()
        shared.unpersist()
        return [(o, v, s, k, array([bytes(n)], o)[0]) for o, v, s, k, n in _first([tuple(r) for r in best], most)]

    model = co_train([array(found.column(c).to_pylist(), k) for k, c in enumerate("ab")], y, ask, rounds, handed)
    delete(spark, folder)
    return model


#: What tasks say of documents that a view is sure of.
SURE = pa.schema([("view", pa.int32()), ("verdict", pa.float64()), ("sure", pa.float64()), ("key", pa.int64()), ("numbers", pa.binary())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [()] * len(SURE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SURE.types, strict=True)], schema=SURE)


def _first(rows: list[tuple], most: dict[float, int]) -> list[tuple]:
    """The surest rows of each view and verdict, one of each key."""
    out, count, seen = [], {}, set()
    for r in sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3])):
        if (r[0], r[1], r[3]) not in seen and count.get(r[:2], 0) < most[r[1]]:
            seen.add((r[0], r[1], r[3]))
            count[r[:2]] = count.get(r[:2], 0) + 1
            out.append(r)
    return out


def score(docs: DataFrame, model: CoTrained, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, p_good, good) of every document.

    Null and empty texts and null metadata have columns of their own in the views; docs without the
    metadata columns counts as null there; repeated rows and null ids stay; an empty table gives an
    empty result; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text_"), *_meta(docs))

    def run(batches):
        for batch in blocks(batches, "text_"):
            p = shared.value.predict(batch.column("text_"), *(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= THRESHOLD)], [id_column, "p_good", "good"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, p_good double, good boolean")


def keep_good(docs: DataFrame, model: CoTrained, text_column: str = "text") -> DataFrame:
    """docs, all columns, without the documents whose p_good is below THRESHOLD. Cases as in score()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch):
        return shared.value.predict(batch.column("text"), *(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))) >= THRESHOLD

    return filtered(docs, keep, text_column, **dict(zip(("source", "lang", "n_chars"), _meta(docs), strict=True)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
