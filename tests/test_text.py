"""Text functions against their definitions in Python."""

import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.graph import Ids, slug

ODD = ["", " ", "a", "  a  b ", "a\tb\nc", "\x1ca\x1d b\x1f", "a b c　", "É Ç;", "a ;", " A\tb ;; ", "A;;", "x;\n", "it's  A-1_b", "!!!", "日本 語", "a <SEP> b<SEP>c\n d   e", None]


def both(spark, build, texts=ODD):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(F.expr(build("t"))).collect()]


def normal(t):
    return re.sub(r"\s+", " ", t.strip().lower()).rstrip(";")


def base(t):
    return "".join(c for c in t.strip().lower().replace(" ", "_") if c.isalnum() or c == "_")


@pytest.mark.parametrize(
    ("build", "own"),
    [
        (T.strip, str.strip),
        (T.word_count, lambda t: len(t.split())),
        (T.normalize, normal),
        (T.slug, base),
        (T.clean_text, lambda t: re.sub(" {2,}", " ", t.replace(" <SEP> ", " ").replace("<SEP>", " ").replace("\n", " "))),
    ],
)
def test_function(spark, build, own):
    got = both(spark, build)
    want = [None if t is None else own(t) for t in ODD]
    if build is T.word_count:
        got[-1] = None  # the size of null is session-dependent
    assert got == want
    if build is T.slug:
        assert [slug(t) for t in ODD if t is not None] == want[:-1]


def test_golden(spark):
    assert both(spark, T.clean_text, ["a <SEP> b<SEP>c\n d   e"]) == ["a b c d e"]
    assert both(spark, T.normalize, ["a ;", " A\tb ;; ", "A;;"]) == ["a ", "a b ", "a"]


@pytest.mark.parametrize(
    ("bases", "ids"),
    [
        (["a", "a", "a_2"], ["a", "a_2", "a_2_2"]),
        (["a", "a_2", "a", "a", "b", "", ""], ["a", "a_2", "a_3", "a_4", "b", "", "_2"]),
        (["a", None, "a", None], ["a", None, "a_2", None]),
        ([], []),
    ],
)
def test_numbered(bases, ids):
    given = Ids()
    assert [None if b is None else given.give(b) for b in bases] == ids


@pytest.mark.parametrize(("truth", "found", "want"), [([], [], (1, 1, 1)), ([], ["a"], (0, 0, 0)), (["a"], [], (0, 0, 0)), (["a", "b"], ["a"], (1, 0.5, 2 / 3))])
def test_measures(spark, truth, found, want):
    rows = spark.createDataFrame([(truth, found)], "t array<string>, x array<string>")
    p, r = T.precision_recall("t", "x")
    got = rows.select(F.expr(p).alias("p"), F.expr(r).alias("r")).selectExpr("p", "r", T.f1("p", "r")).first()
    assert tuple(got) == pytest.approx(want)
