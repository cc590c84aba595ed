"""The classifiers against brute force, and what their methods add."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality, toxicity, words
from weftline.llm.common import plain, table

DATA = "/root/testdata/sf0.01"
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
TEXTS = ["", None, "One two, two two.", "AA aa Aa!!! $$ x9", "é É ß 日本\n\nline line", "word " * 500, "x" * 300, "a b a b a b, c.", "\t\n ", "toxic-ish wordings\x00 here"]


def hash_of(piece: bytes, beginning: bool) -> int:
    low = np.zeros(len(piece) + 8, np.uint8)
    low[: len(piece)] = np.frombuffer(piece, np.uint8)
    if beginning:
        return int(words.mix(words.eight(low, np.array([0])) + np.uint64(len(piece) * 0x9E3779B97F4A7C15 % 2**64))[0])
    return int(words.hashes(low, np.array([0]), np.array([len(piece)]))[0])


def features_of(text) -> set:
    found = set()
    for w in LETTERS.findall((text or "").translate(LOWER)):
        w = w.encode()
        found.add(hash_of(w, False))
        found |= {hash_of(w[:n], True) for n in toxicity.STEMS if len(w) > n}
    return found


def test_chain_is_brute_force(spark):
    """Scores by sets of words and beginnings, one document and one category after another."""
    docs = table(spark, DATA, "documents")
    chain = toxicity.train(docs, table(spark, DATA, "labels"))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + r.doc_id, r.text) for r in docs.limit(40).collect()]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    place = {int(h): k for k, h in enumerate(chain.vocabulary.hashes)}
    for i, text in rows:
        has = [place[h] for h in features_of(text) if h in place]
        earlier = []
        for beta in chain.models:
            z = beta[-1] + sum(beta[k] for k in has) + sum(b * x for b, x in zip(beta[len(place) : -1], earlier, strict=True))
            p = 1 / (1 + math.exp(-min(40, max(-40, z))))
            earlier.append(min(8, max(-8, math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))))) / 8)
        assert got[i].p_toxic == pytest.approx(p, rel=1e-9) and got[i].toxic == (p >= chain.threshold)


def test_later_categories_use_earlier_ones():
    """The second category is the first one's opposite where a word stands, which no linear model of words alone can say."""
    rng = np.random.default_rng(0)
    n = 1200
    x = rng.integers(0, 2, (n, 12))
    first = (x[:, :4].sum(1) >= 2).astype(float)
    second = (first + 0.8 * x[:, 5] + 0.3 * rng.normal(size=n) > 1.1).astype(float)
    lists = [np.flatnonzero(r) for r in x]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in lists])))
    sparse = toxicity.Sparse(np.concatenate(lists), bounds, 12)
    fold = np.arange(n) % toxicity.FOLDS
    _, both = toxicity._fit_chain(sparse, np.column_stack([first, second]), np.ones(n), fold)
    models, alone = toxicity._fit_chain(sparse, second[:, None], np.ones(n), fold)
    right = lambda p: ((p >= 0.5) == (second == 1)).mean()
    assert len(models) == 1 and right(both[:, 1]) > right(alone[:, 0])


def test_unknown_labels_weigh_nothing():
    sparse = toxicity.Sparse(np.array([0, 0, 1, 1]), np.arange(5), 2)
    y = np.array([[1.0, 1], [np.nan, 1], [0, 0], [np.nan, 0]])
    models, out = toxicity._fit_chain(sparse, y, np.ones(4), np.arange(4) % toxicity.FOLDS)
    assert np.isfinite(out).all() and all(np.isfinite(m).all() for m in models)


def test_near_copies_are_left_out_and_replaced():
    base = list(range(16))
    rows = [(1, 1, *base), (2, 1, *base[:13], 90, 91, 92), (3, 1, *base[:12], 90, 91, 92, 93), (4, 0, *base), (5, 1, *range(50, 66)), (6, 0, *range(70, 86)), (7, 0, *range(100, 116))]
    assert toxicity._apart(rows, {1: 2, 0: 1}) == [1, 3, 6]
    assert toxicity._apart(rows, {1: 9, 0: 9}) == [1, 3, 5, 6, 7]


def test_labels_without_quality(spark):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"vile words {i}") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("toxic"))
    chain = toxicity.train(docs, labels)
    assert chain.names == ["toxic"]
    assert {r.doc_id for r in toxicity.score(docs, chain).where("toxic").collect()} == set(range(0, 60, 2))


def test_repeated_ids_count_once(spark):
    """A document that is there a thousand times, with one id, is one document."""
    one = [(i, f"good words {i}" if i % 2 else f"vile words {i}") for i in range(60)]
    docs = spark.createDataFrame(one + one[:1] * 1000 + [(2, "zzz")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, (i + 1) % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.train(d, labels) for d in (docs, spark.createDataFrame(one, "doc_id long, text string")))
    assert (a.vocabulary.hashes == b.vocabulary.hashes).all() and all(np.allclose(x, y) for x, y in zip(a.models, b.models, strict=True))


# quality


def content_of(text) -> list:
    data = (text or "").encode()
    count = lambda test: sum(1 for b in data if test(b))
    total, low, up, digits = max(len(data), 1), count(lambda b: 97 <= b < 123), count(lambda b: 65 <= b < 91), count(lambda b: 48 <= b < 58)
    shares = [count(lambda b, c=c: b == c) / total for c in quality.PUNCTUATION] + [up / total, digits / total, count(lambda b: b >= 128) / total, data.count(10) / total, data.count(32) / total, count(lambda b: b < 9) / total]
    raw = [w.encode() for w in SPACED.findall(text or "")]
    w = [x.encode() for x in SPACED.findall((text or "").translate(LOWER))]
    n, most = len(w), max(len(w), 1)
    repeats = [sum(w[i] == w[i - lag] for i in range(lag, n)) / most for lag in (1, 2, 3)]
    pairs = list(zip(w, w[1:], strict=False))
    length = [len(x) for x in w]
    mean = sum(length) / most
    spread = math.sqrt(max(sum(x * x for x in length) / most - mean**2, 0))
    sign = [32 < x[-1] < 127 and not chr(x[-1]).isalnum() for x in raw]
    ordinary = [x[-1:] in b".,;:?!\"')" for x in raw]
    double = [s and len(x) > 1 and x[-2] == x[-1] for s, x in zip(sign, raw, strict=True)]
    part = lambda m: math.sqrt(sum(m) / most)
    lines = data.count(10) + 1
    logs = [math.log1p(v) / 5 for v in (n, len(data), len(data) / lines, n / lines)]
    return [
        *map(math.sqrt, shares), up / max(up + low, 1), *map(math.sqrt, repeats), len(set(w)) / most, math.sqrt((len(pairs) - len(set(pairs))) / most), mean / 10, spread / 10,
        part([s and not o for s, o in zip(sign, ordinary, strict=True)]), part(ordinary), part(double), part([x == 1 for x in length]), *logs, float(n == 0),
    ]


def test_content_is_brute_force(spark):
    texts = TEXTS + [r.text for r in table(spark, DATA, "documents").limit(60).collect()]
    got = quality.content(pa.array(texts))
    assert len(plain(pa.array(texts))[1]) == len(texts) + 1
    for row, text in zip(got, texts, strict=True):
        assert list(row) == pytest.approx(content_of(text), abs=1e-9)


def test_scores_are_brute_force(spark):
    """The verdicts of whole tables are those of documents taken one by one, by the fitted numbers in plain Python."""
    docs = table(spark, DATA, "documents")
    model = quality.train(docs, table(spark, DATA, "labels"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for r in docs.limit(60).collect():
        odds = []
        for view, x in zip(model.views, (content_of(r.text), quality.metadata([r.source], [r.lang], [r.n_chars])[0]), strict=True):
            z = view.beta[-1] + sum(b * min(6, max(-6, (v - m) / s)) for b, v, m, s in zip(view.beta[:-1], x, view.mean, view.scale, strict=True))
            p = min(max(1 / (1 + math.exp(-min(40, max(-40, z)))), 1e-6), 1 - 1e-6)
            odds.append(min(12, max(-12, math.log(p / (1 - p)) * view.line[0] + view.line[1])))
        p = 1 / (1 + math.exp(-(model.combination[2] + sum(a * b for a, b in zip(model.combination[:2], odds, strict=True)))))
        assert got[r.doc_id].p_good == pytest.approx(p, rel=1e-6) and got[r.doc_id].good == (p >= quality.THRESHOLD)


def drawn(rng, n, dimensions=25):
    y = rng.integers(0, 2, n).astype(float)
    return [y[:, None] * 0.5 + rng.normal(size=(n, dimensions)), np.column_stack([y * 4 + rng.normal(size=n), rng.normal(size=n)])], y


def accuracy(model, test, truth):
    odds = np.column_stack([v.log_odds(t) for v, t in zip(model.views, test, strict=True)])
    return (((odds @ model.combination[:2] + model.combination[2]) > 0) == (truth == 1)).mean()


def test_views_teach_each_other():
    """Labels are few, the second view is plain, and rounds carry what it shows over to the first."""
    rng = np.random.default_rng(0)
    gains = []
    for _ in range(5):
        (x, y), (pool, _), (test, truth) = (drawn(rng, n) for n in (60, 3000, 3000))
        alone, taught = quality.co_train(x, y, pool, rounds=0), quality.co_train(x, y, pool)
        first = lambda m: ((m.views[0].log_odds(test[0]) > 0) == (truth == 1)).mean()
        assert first(taught) > first(alone) + 0.01
        gains.append(accuracy(taught, test, truth) - accuracy(alone, test, truth))
    assert min(gains) > -0.01 and np.mean(gains) > 0.002


def test_views_without_a_clue_keep_silent():
    rng = np.random.default_rng(1)
    x, y = drawn(rng, 100)
    pool, _ = drawn(rng, 2000)
    for views in (x, pool):
        views[1] = rng.normal(size=views[1].shape)
    a, b = (quality.co_train(x, y, pool, rounds=r) for r in (0, 4))
    assert np.allclose(a.views[0].beta, b.views[0].beta)


def test_rounds_take_from_all_documents(spark):
    """What is handed over is the surest of the whole corpus, one of equal ones, whatever the partitions."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    copies = docs.union(docs.join(labels, "doc_id", "left_anti").where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10**6)).repartition(7)
    a, b = quality.train(docs, labels, handed=20), quality.train(copies, labels, handed=20)
    assert all(np.allclose(x.beta, y.beta, atol=1e-6) for x, y in zip(a.views, b.views, strict=True))
