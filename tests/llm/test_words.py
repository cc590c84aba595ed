"""Words, their hashes, and decontamination where hashes or texts are out of the ordinary."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, words
from weftline.llm.common import plain


def thue_morse(n: int, flip: int = 0) -> str:
    return "".join("ab"[(k.bit_count() + flip) & 1] for k in range(n))


def test_equal_words_have_equal_hashes_and_others_not():
    base = ["a", "b", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefgh" * 8, "abcdefgh" * 8 + "x", "é", "日本語", *(thue_morse(2**k, f) for k in range(3, 13) for f in (0, 1))]
    rng = np.random.default_rng(0)
    base += ["".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 100, 5000)]
    base = sorted(set(base))
    first, hashes, starts, ends = words.scan(*plain(pa.array([" ".join(base), " ".join(x.upper() if x.isascii() else x for x in base[::-1])])), "spaced")
    assert first.tolist() == [0, len(base), 2 * len(base)]
    assert (hashes[: len(base)] == hashes[len(base) :][::-1]).all()
    assert len(np.unique(hashes)) == len(base)


def test_bytes_are_compared():
    data, offsets = plain(pa.array(["aaaaaaaa aaaaaaab " + "x" * 100 + " " + "x" * 99 + "y aaaaaaaab aaaaaaaab"]))
    first, starts, ends = words.spans(data, offsets, "spaced")
    low, n = words.lowered(data), ends - starts
    a, b = np.array([0, 0, 2, 2, 4, 4]), np.array([0, 1, 2, 3, 5, 4])
    assert words.equal(low, starts[a], low, starts[b], n[a]).tolist() == [True, False, True, False, True, True]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words_that_patterns_make_alike(spark):
    """Thue-Morse words, which polynomial hashes can not tell apart."""
    one, two = thue_morse(2048), thue_morse(2048, 1)
    tail = " ".join(f"w{k}" for k in range(12))
    bench = spark.createDataFrame([(1, f"{one} {tail}"), (2, two)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.annotate(documents(spark, [f"{one} {tail}", f"{two} {tail}", one]), bench).collect()}
    assert got == {0: (13, ["1"]), 1: (1, ["2"]), 2: (0, [])}


def test_words_found_by_hash_are_verified(monkeypatch):
    """With a hash of eleven bits many words seem to match; results stay those of the words."""
    text = " ".join(f"w{k % 40}" for k in range(300))
    items = [(1, " ".join(text.split()[10:40])), (2, "w3 w4"), (3, "w4 w3"), (4, "other")]
    texts = pa.array([text, "w3 w4 w3", "x " * 50 + "other", *(f"q{k} w4 w3 q{k + 1}" for k in range(500))])
    known = lambda tests, shard: (tests.ids(shard.hashes(tests.seed)) > 0).sum()
    tests, shard = decontaminate.TestSuffixes(items), decontaminate.Shard(*plain(texts))
    want, words_known = tests.judge(shard), known(tests, shard)
    monkeypatch.setattr(decontaminate, "hashes", lambda *x: words.hashes(*x) & np.uint64(0x7FF))
    tests, shard = decontaminate.TestSuffixes(items), decontaminate.Shard(*plain(texts))
    assert known(tests, shard) > words_known
    got = tests.judge(shard)
    assert (got[0] == want[0]).all() and got[1:] == want[1:]


def test_longest_match_of_each_document(spark):
    long = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "z " + " ".join(long[:20])), (3, "the cat"), (None, "q r")], "item_id long, text string")
    texts = ["x " + " ".join(long[3:33]) + " y " + " ".join(long[:13]), "z " + " ".join(long[:20]) + " the cat", "q r", "none", None, "the cat the cat", " ".join(["aa"] * 30)]
    rows = decontaminate.annotate(documents(spark, texts), bench)
    got = {r.doc_id: (r.longest, r.longest_word, r.longest_item) for r in rows.collect()}
    assert got == {0: (30, 1, "1"), 1: (21, 0, "2"), 2: (2, 0, None), 3: (0, None, None), 4: (0, None, None), 5: (2, 0, "3"), 6: (0, None, None)}
    several = decontaminate.annotate(documents(spark, texts), bench, most=20)
    assert sorted(map(str, several.collect())) == sorted(map(str, rows.collect()))


def test_matches_in_repetitive_texts(spark):
    bench = spark.createDataFrame([(1, " ".join(["aa"] * 15 + ["b"] + ["aa"] * 13))], "item_id long, text string")
    text = " ".join(["aa"] * 16 + ["b"] + ["aa"] * 14)
    got = sorted(tuple(r)[1:] for r in decontaminate.matches(documents(spark, [text]), bench).collect())
    a, b = text.split(), (["aa"] * 15 + ["b"] + ["aa"] * 13)
    want = []
    for i in range(len(a)):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= 13:
                want.append((i, n, 1, j))
    assert got == sorted(want)


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_removal_with_odd_column_names(spark, most):
    rows = spark.createDataFrame([(1, "the cat", 5, 6), (2, "a dog", 7, 8), (2, None, 7, 8)], "`my id` long, text string, `items` int, `a.b c-d` int")
    bench = spark.createDataFrame([(1, "the cat"), (2, "no such thing"), (3, None)], "item_id long, text string")
    kept = decontaminate.remove(rows, bench, most=most)
    assert kept.columns == rows.columns
    assert sorted((r[0], r[1] or "") for r in kept.collect()) == [(2, ""), (2, "a dog")]
    assert decontaminate.annotate(rows, bench, id_column="my id", most=most).where(F.col("n_hit") > 0).count() == 1
