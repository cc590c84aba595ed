"""Language-model scores: a proper distribution, and the one that brute force gives."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import lm
from weftline.llm.common import table

DATA = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
ODD = ["", None, " ", "a", "  a  b ", "é É ß", "日本 語の テキスト", "\x00\t\n\r", "word " * 3000, "x" * 5000, "a b a b a b a b c"]


def words_of(text):
    return [*SPACED.findall((text or "").translate(LOWER)), None]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", True) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_tokens int, words string, held_out boolean")


def trained(texts):
    """Exact counts of words, pairs and triples of the training texts."""
    counts = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = ["<s>", *words_of(t)]
            counts.update((x,) for x in w[1:])
            counts.update(zip(w, w[1:], strict=False))
            counts.update(zip(w, w[1:], w[2:], strict=False))
    return counts


def level(floors, n):
    return max(k for k, f in enumerate(floors) if f <= n)


class Brute:
    """The probability of a word after others, in plain Python, from exact counts."""

    def __init__(self, counts, totals):
        self.counts, self.totals = counts, totals
        words, grams = [1, 2], [1, 2]
        words, grams = list(range(17)), list(range(9))
        while words[-1] < 1 << 42:
            words.append(int(words[-1] * 1.12))
        while grams[-1] < 1 << 42:
            grams.append(int(grams[-1] * 1.25))
        self.words, self.grams = words, grams
        single = [n for g, n in counts.items() if len(g) == 1]
        self.v = len(single)
        self.total = sum(words[level(words, n)] for n in single)

    def most(self, floors, n):
        return floors[level(floors, n) + 1] - 1

    def spare(self, order, context, after):
        a, b = after * self.totals.chance[order], 1.25 * context * self.totals.chances[order]
        return (order - 1) * (1 + a + 5 * math.sqrt(a)) + b + 5 * math.sqrt(b)

    def weight(self, order, floors, n):
        k = level(floors, n)
        return 0.0 if n == 0 else self.totals.weights[order][k if k <= 8 else 8 + (k - 8) // {2: 8, 3: 4}[order] * {2: 8, 3: 4}[order]]

    def __call__(self, history, word):
        c = self.counts
        n = c[(word,)]
        one = (self.words[level(self.words, n)] + 0.5) / (self.total + 0.5 * (self.v + 1))
        before = history[-1] if len(history) > 1 else None
        context = c[(before,)] if len(history) > 1 else 0
        two = three = 0.0
        if n and context:
            most = self.most(self.words, context)
            pair = c[(before, word)]
            two = min(1, self.grams[level(self.grams, pair)] / (most + self.spare(2, most, self.v)))
            above = c[tuple(history[-2:])]
            triple = c[(*history[-2:], word)]
            if pair and above and triple >= 2:
                three = min(1, self.grams[level(self.grams, triple)] / (self.most(self.grams, above) + self.spare(3, self.most(self.grams, above), min(most, self.v))))
        above = c[tuple(history[-2:])] if len(history) > 1 else 0
        v, w = self.weight(2, self.words, context), self.weight(3, self.grams, above)
        return w * three + (1 - w) * (v * two + (1 - v) * one)


def held(model):
    ((_, pieces),) = model.blocks
    return lm.Block.of_pieces([outline for _, outline in pieces], (p.value for p, _ in pieces))


def corpus(spark):
    return ODD + [r.text for r in table(spark, DATA, "documents").orderBy("doc_id").limit(60).collect()]


def test_base_score_and_counts(spark):
    texts = corpus(spark)
    got = {r.doc_id: r for r in lm.score(docs(spark, texts)).collect()}
    c = trained(texts)
    n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    for i, w in enumerate(map(words_of, texts)):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[(x,)] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w))


@pytest.fixture(scope="module")
def model(spark):
    """(texts, Spark's scores, the model with the weights that they were made with)"""
    texts = corpus(spark)
    kept = []
    fit = lm._fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "_fit", lambda probed, totals: (fit(probed, totals), kept.append(totals)))
        got = {r.doc_id: r.score for r in lm.score(docs(spark, texts)).collect()}
    made = lm.Model(docs(spark, texts), "doc_id", "text")
    made.totals = kept[0]
    return texts, got, made


def test_scores_are_brute_force(model):
    """Levels that the filter raises by chance aside, which the next test counts, scores are those of exact counts."""
    texts, got, made = model
    brute = Brute(trained(texts), made.totals)
    assert (brute.v, brute.total) == (made.totals.v, made.totals.floors)
    close = 0
    for i, t in enumerate(texts):
        w = ["<s>", *words_of(t)]
        want = sum(math.log10(brute(w[:k], w[k])) for k in range(1, len(w)))
        close += got[i] == pytest.approx(want, rel=1e-9)
        assert got[i] == pytest.approx(want, rel=2e-2)
    assert close > 0.5 * len(texts)


def test_levels_are_those_of_exact_counts(model):
    texts, _, made = model
    counts = trained(texts)
    block = held(made)
    first, words, pairs, triples = lm.tokens(pa.array(texts))
    exact, two, three = lm.probe(block, words, pairs, triples)
    at = wrong = 0
    for t in texts:
        w = ["<s>", *words_of(t)]
        for k in range(1, len(w)):
            pair, triple = counts[(w[k - 1], w[k])], counts[tuple(w[k - 2 : k + 1])] if k > 1 else 0
            assert exact[at] == counts[(w[k],)]
            want = lm.GRAMS.of(np.array([pair, triple if triple > 1 else 0]))
            assert two[at] >= want[0] and (k == 1 or three[at] >= want[1])
            wrong += two[at] != want[0] or k > 1 and three[at] != want[1]
            at += 1
    assert at == len(words) and wrong < 0.02 * at


def test_probabilities_sum_to_one_at_most(spark, model):
    """Over all words and an unknown one, after 300 contexts of two words, rare ones and unseen ones among them."""
    texts, _, made = model
    block, totals = held(made), made.totals
    vocabulary = np.concatenate([block.words, [np.uint64(12345)]])
    rng = np.random.default_rng(0)
    first, words, pairs, _ = lm.tokens(pa.array(texts))
    inner = np.setdiff1d(np.arange(1, len(words)), first)
    places = np.concatenate((rng.choice(inner, 150), inner[np.argsort(lm.probe(block, words, pairs, pairs)[0][inner - 1])[:: max(1, len(inner) // 150)]]))
    sums = []
    for p in places:
        # the pair at p is the context; words[p] is the last word before the one that is asked for
        here = np.full(len(vocabulary), words[p])
        counts, two, three = lm.probe(block, vocabulary, lm.join(here, vocabulary), lm.join(np.full(len(vocabulary), pairs[p]), vocabulary))
        (before,), (pair_before,), _ = lm.probe(block, words[p : p + 1], pairs[p : p + 1], pairs[p : p + 1])
        known = totals.probability(lm.WORDS.of(counts), two, three, np.full(len(vocabulary), lm.WORDS.of(np.array([before]))[0]), np.full(len(vocabulary), pair_before))
        sums.append(known.sum())
    assert len(sums) >= 300 and max(sums) <= 1 + 1e-6 and min(sums) > 0.3
    alone = totals.probability(lm.WORDS.of(lm.probe(block, vocabulary, vocabulary, vocabulary)[0]), *(np.zeros(len(vocabulary), np.uint8) for _ in range(4))).sum()
    assert alone == pytest.approx(1)


def test_weights_come_from_all_training_texts(spark):
    """Weights are those of all tokens, one by one, with their own occurrence taken out."""
    texts = corpus(spark)
    rows = docs(spark, texts)
    made = lm.Model(rows, "doc_id", "text")
    first, *grams = lm.tokens(pa.array(texts))
    counts, two, three = lm.probe(held(made), *grams)
    train = np.repeat(lm.fold(range(len(texts))) != lm.HELD_OUT, np.diff(first))
    seen = lm._seen(first, lm.WORDS.of(counts), two, three)
    kinds = (lm.WORDS, lm.GRAMS, lm.GRAMS, lm.WORDS, lm.GRAMS)
    made.totals.fit([k.representative[k.without_one[x[train]]] for k, x in zip(kinds, seen, strict=True)], np.ones(train.sum()))
    want = np.add.reduceat(np.log10(made.totals.probability(*seen)), first[:-1])
    got = {r.doc_id: r.score for r in lm.score(rows).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(list(want), rel=1e-7)


def test_model_beats_base_on_held_out_texts(spark):
    r = lm.op7_lm(spark, DATA.replace("0.001", "0.01")).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.4


def test_texts_that_occur_twice_score_apart(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 80)) for _ in range(300)]
    ids = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 != 1][: 300 + 20]
    rows = docs(spark, texts + texts[:20], ids)
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(rows).collect()}
    twice, once = [got[i] for i in ids[:20]], [got[i] for i in ids[20:300]]
    assert min(twice) > max(once)


@pytest.mark.parametrize("most", [20_000, 60_000])
def test_several_blocks_give_the_scores_of_one(spark, most):
    rows = table(spark, DATA, "documents").limit(40)
    found = []
    for m in (lm.BLOCK_MODEL, most):
        n = len(lm.Model(rows, "doc_id", "text", m, segment_bytes=1000).blocks)
        assert n == 1 if m == lm.BLOCK_MODEL else n >= 2
        found.append({r.doc_id: r for r in lm.score(rows, most=m, segment_bytes=1000).collect()})
    one, many = found
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert many[i].score == pytest.approx(r.score) and many[i].base_score == pytest.approx(r.base_score) and many[i].n_known == r.n_known


def test_one_block_at_a_time(spark, monkeypatch):
    """A block is sent when its pass begins and freed before the next; none is left, nor the table they come from."""
    rows = table(spark, DATA, "documents")
    sent, held = [], []
    real = spark.sparkContext.broadcast

    class Kept:
        def __init__(self, value):
            self.inner, self.size = real(value), len(value.segments)
            sent.append(self.size)
            held.append(self)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __reduce__(self):
            return self.inner.__reduce__()

        def destroy(self):
            held.remove(self)
            self.inner.destroy()

    model = lm.Model(rows, "doc_id", "text", 120_000, segment_bytes=10_000)
    assert len(model.blocks) >= 3
    passes = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: Kept(value) if isinstance(value, lm.Block) else real(value))
    monkeypatch.setattr(lm, "_release", lambda block, f=lm._release: (passes.append(sum(k.size for k in held)), f(block)))
    lm.score(rows, most=120_000, segment_bytes=10_000).count()
    assert len(passes) == len(model.blocks) and sum(passes) == sum(sent) == sum(len(p) for b in model.blocks.plan for p in b) and not held


def test_numbers_are_packed():
    for values in ([], [0], [1, 255], [256, 3], [2**40, 7], [2**64 - 1, 0]):
        values = np.array(values, np.uint64)
        assert (lm._unpack(lm._pack(values), len(values)) == values).all()


def test_filter_never_misses_and_seldom_invents():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    levels = lm.GRAMS.of(rng.geometric(0.3, len(grams)))
    first, more, chance, chances = lm._filter(grams, levels, 1)
    a, b = (lm.Cells(np.array([len(x) // lm.LANES]), x, bits[1]) for x, bits in ((first, lm.FIRST), (more, lm.MORE)))
    here = np.zeros(len(grams), np.int64)
    assert len(a.holds(lm._entry(grams, 1), here)) == len(grams)
    assert set(np.flatnonzero(levels >= 3)) <= set(b.holds(lm._entry(grams, 3), here))
    others = rng.integers(0, 2**63, 2_000_000, dtype=np.uint64)
    here = np.zeros(len(others), np.int64)
    for cells, claimed, most in ((a, chance, 3e-5), (b, chances, 8e-3)):
        share = len(cells.holds(lm._entry(others, 2), here)) / len(others)
        assert share < most and share == pytest.approx(claimed, rel=0.5)


def test_odd_tables(spark):
    rows = docs(spark, ["a b", "a b", None], [1, 1, None])
    assert lm.score(rows).count() == 3
    assert lm.score(rows.limit(0)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    r = lm.score(docs(spark, ["a b", ""], held)).collect()
    assert {x.train_tokens for x in r} == {0} and all(math.isfinite(x.score) and x.score <= 0 for x in r)
