"""Ranked search against plain scoring of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from weftline.llm import search
from weftline.llm.common import table

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def counts(text):
    return collections.Counter(TERM.findall((text or "").translate(LOWER)))


def plain_search(docs, queries, k=10):
    held = [(i, counts(t)) for i, t in docs]
    n, terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // max(terms, 1)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in counts(text).items() if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(q, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def test_table(spark):
    got = search.op11_search(spark, DATA)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = lambda name, i: [(r[i], r.text) for r in table(spark, DATA, name).collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows("documents", "doc_id"), rows("benchmark", "item_id"))


@pytest.mark.parametrize(("segment", "block", "k"), [(1, 1, 3), (200, 100, 10), (search.SEGMENT, search.QUERY_BYTES, 2)])
def test_odd_rows_in_small_segments(spark, segment, block, k):
    """Ties, copies, nulls, repeated ids and queries, texts without terms, clashing names; any segments and blocks of queries."""
    rng = random.Random(segment)
    vocabulary = ["the", "The", "a", "harbour", "x" * 80, "Ünder", "ünder", "中文", "1234", "é", "end"]
    words = lambda most: " ,".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(most)))
    docs = [(rng.choice([None, *range(-40, 40)]), rng.choice([None, "", " ,", words(12), words(60)])) for _ in range(150)] + [(500 + i, "a common copy of the harbour") for i in range(60)] + [(900, "the " * 5000)]
    queries = [(rng.choice([None, 1, 2, 3]) if i > 6 else i, rng.choice([None, "", "unknown words", words(9), words(9), words(20)])) for i in range(25)]
    left = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, terms string").repartition(3)
    right = spark.createDataFrame([(i, t, 1, 2.0) for i, t in queries], "item_id long, text string, rank int, score double")
    got = search.search(search.index(left, segment=segment).cache(), right, k=k, query_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, queries, k)
    empty = search.index(left.limit(0))
    assert search.search(empty, right).count() == 0 and search.search(search.index(left), right.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_merge_leaves_out_only_what_cannot_win(seed):
    """Lists of random gains, segment after segment: the best are those of full scores, ties by id."""
    rng = random.Random(seed)
    k, best, scores = rng.choice([1, 2, 5]), [], collections.Counter()
    times = [rng.choice([1, 1, 3]) for _ in range(6)]
    for part in range(4):
        ids = sorted(rng.sample(range(1000), 40))
        lists = []
        for t in times:
            held = sorted(rng.sample(range(40), rng.randrange(41)))
            gains = [rng.choice([0, 1, 2, 5, 9, 30 * (t == 1)]) for _ in held]
            if held:
                lists.append((search._List(held, gains), t))
            for d, g in zip(held, gains, strict=True):
                scores[part, ids[d]] += g * t
        if lists:
            search._rank(lists, ids, best, k)
    want = sorted(((s, -i) for (_, i), s in scores.items() if s > 0), reverse=True)[:k]
    assert sorted(best, reverse=True) == want


def test_terms_that_share_a_hash(spark, monkeypatch):
    import pyarrow as pa

    from weftline.llm.common import plain

    monkeypatch.setattr(search.words, "hashes", lambda low, starts, lengths, seed=0: np.zeros(len(starts), np.uint64))
    segment = search._Segment()
    segment.add(pa.array([2, 1]), *plain(pa.array(["one two three two", "two TWO one"])))
    row = dict(zip(search._TYPES.names, segment.row(), strict=True))
    assert row["terms"].split(b"\n") == [b"one", b"two", b"three"]
    lists = search._lists(row, {b"two": 0, b"one": 1, b"three": 2}, [1, 1, 1], 2, 7)
    assert [lists[i].documents for i in range(3)] == [[0, 1], [0, 1], [1]]


def test_long_lengths_do_not_overflow():
    assert search._sizes(np.array([10**7]), 10**13, 10**15).tolist() == [25 + 75 * 10**7 * 10**13 // 10**15]
