"""Vectors, URLs, pages, chats, classifiers and the pipeline."""

import hashlib
import html as escapes
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import caps, chat, decontaminate, html, quality, registry, simhash, toxicity, urls
from weftline.llm.common import table

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    text = lambda df: sorted(tuple("null" if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and text(got) == text(want)


# vectors


def plain_links(ids, vectors, least=0.95):
    ok = [i for i, v in enumerate(vectors) if ids[i] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, low = [0] * len(ids), dict(enumerate(ids))
    close = {(a, b) for a in ok for b in ok if a != b and len(vectors[a]) == len(vectors[b]) and np.dot(vectors[a], vectors[b]) / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]) >= least}
    for a, _ in close:
        links[a] += 1
    while True:
        before = dict(low)
        for a, b in close:
            low[a] = min(low[a], low[b])
        if before == low:
            return links, [low[i] for i in range(len(ids))]


@pytest.mark.parametrize("options", [{}, {"chunk": 32, "words": 16}])
def test_caps_are_brute_force(spark, options):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 6))
    vectors = [list(map(float, base[k % 30] + rng.normal(size=6) * 0.12)) for k in range(180)]
    vectors += [vectors[0]] * 20 + [[2 * x for x in vectors[0]], [-0.0 if x == 0 else x for x in vectors[1]], [1.0, 2.0], [1.0, 2.1], None, [], [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1e-300, 1e-300, 0.0, 0.0, 0.0, 0.0], [1e300, 1e300, 0.0, 0.0, 0.0, 0.0]]
    ids = list(range(len(vectors)))
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, rep string, n_links int")
    got = {r.vec_id: r for r in caps.near_vectors(rows, **options).collect()}
    links, low = plain_links(ids[:-2], vectors[:-2])
    assert [got[i].n_links for i in ids[:-2]] == links and [got[i].component_id for i in ids[:-2]] == low
    # the last two have one direction, at sizes whose squares are no numbers
    assert [got[i].n_links for i in ids[-2:]] == [1, 1] and got[ids[-1]].component_id == ids[-2]
    assert caps.near_vectors(rows.limit(0)).count() == 0


def test_caps_with_ids_that_stand_for_several_vectors(spark):
    near = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.99, 0.1, 0.0]), (4, [0.1, 0.99, 0.0])]
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 5))
    more = [(k % 13, list(map(float, base[k % 8] + rng.normal(size=5) * 0.15))) for k in range(90)]
    for rows in (near, more):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
        links, low = plain_links([i for i, _ in rows], [v for _, v in rows])
        assert got == sorted(zip([i for i, _ in rows], links, low, strict=True))


def test_caps_recall(spark):
    rows = caps.op4_caps(spark, "/root/testdata/sf0.01").toPandas().sort_values("vec_id")
    source = table(spark, "/root/testdata/sf0.01", "embeddings").toPandas().sort_values("vec_id")
    rng = np.random.default_rng(4)
    u = np.stack(source.embedding.to_numpy()).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert (rows.n_links.to_numpy() == ((u @ u.T >= 0.95).sum(1) - 1)).all()
    # planted neighbours a little inside the bound
    noise = rng.normal(size=u.shape)
    noise -= (noise * u).sum(1, keepdims=True) * u
    near = 0.951 * u + np.sqrt(1 - 0.951**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    both = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(np.vstack([u, near]))], "vec_id long, embedding array<double>")
    found = sum(r.n_links > 0 for r in caps.near_vectors(both).where(f"vec_id < {len(u)}").collect())
    assert found >= 0.99 * len(u)


# URLs


URLS = [
    ("https://a.net/x", "a.net", "/x", "net/", "block"),
    ("http://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("x://example.com/de/#", "example.com", "/de/", "example.com/de/", "block"),
    ("x://example.com/DE/", "example.com", "/DE/", None, None),
    ("x://b.org/fr/a", "b.org", "/fr/a", "org/fr/", "allow"),
    ("x://notnet/a", "notnet", "/a", None, None),
    ("x://a.net", "a.net", "", None, None),
    ("x://a.net?p=/", "a.net", "", None, None),
    ("a.net/x", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("x://É.net/é\n?", "É.net", "/é\n", "net/", "block"),
    ("x://" + "a" * 20000 + ".net/", "a" * 20000 + ".net", "/", "net/", "block"),
]


def test_rules_and_odd_urls(spark):
    rows = spark.createDataFrame([(i, u[0], "x", 1) for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x", 1)], "page_id long, url string, host string, rows int")
    got = sorted((tuple(r) for r in urls.judge(rows).select("page_id", "host", "path", "rule", "verdict").collect()), key=lambda r: r[0])
    assert len(got) == len(URLS) + 1
    for i, host, path, rule, verdict in got:
        assert (host, path, rule) == URLS[i][1:4]
        assert verdict == (URLS[i][4] or verdict) and verdict in ("allow", "block")
    assert urls.judge(rows.limit(0)).count() == 0


def test_model_learns_what_rules_do_not_say(spark):
    good = [f"http://good-garden{i}.example.net/en/flowers{i}" for i in range(60)]
    bad = [f"http://casino-win{i}.net/spin{i}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate([*good, *bad, "http://casino-win.example.org/spin7", "http://good-garden.example.org/en/flowers9"])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(rows).collect()}
    assert (got[120], got[121]) == ("block", "allow")


def test_urls_run_without_python(spark):
    plan = urls.op6_urls(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# pages


def article(page):
    inner = page[page.index("<article>") + 9 : page.rindex("</article>")].replace("<br>", " ")
    inner = re.sub(r"<!--.*?-->", "", inner, flags=re.S)
    parts = [" ".join(escapes.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


def test_pages_of_the_table(spark):
    rows = table(spark, DATA, "pages").collect()
    assert [html.main_text(r.html) for r in rows] == [article(r.html) for r in rows]


def test_page_without_article_element():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div><div class="wrap">
    <div class="post-content"><h1>T &amp; x</h1><p>One, two, three and so on for a while.<p>Short.</p><ul><li>item one</li><li>item <a href=x>two</a></li></ul>
    <ul><li><a href=1>a</a><li><a href=2>b</a></ul><table><tr><td>c<td>d</table>bare text<br>more<blockquote>Quote</blockquote></div>
    <div class="comments"><p>A long reader comment, with commas, and more, and more.</p></div><div class="sidebar"><p>x, y, z, w</p></div></div>
    <form><p>Name</p></form><aside>aside</aside><footer>foot</footer><script>var x="<p>no</p>"</script></body></html>"""
    assert html.main_text(page).split("\n\n") == ["T & x", "One, two, three and so on for a while.", "Short.", "item one", "item two", "c", "d", "bare text more", "Quote"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div id=top>Home | About</div><div class=wrap><h1>Title</h1><div class=part><p>First part has words, yes.</p></div><h2>Sub</h2><div class=part><p>Tiny.</p></div><h3>Related</h3><ul><li><a href=1>x</a></li><li><a href=2>y</a></li></ul></div>", "Title|First part has words, yes.|Sub|Tiny."),
        ("<h1>Recipe</h1><p>Ingredients</p><ul><li>one, two, three</li><li>four, five, six</li></ul><p>Mix.</p>", "Recipe|Ingredients|one, two, three|four, five, six|Mix."),
        ('<main><article><h1>A</h1><section><p>One.</p></section><section><p>Two, with, many, commas.</p></section></article><section class="comments"><article class="comment"><p>Bad, bad, bad.</p></article></section></main>', "A|One.|Two, with, many, commas."),
        ("<table><tr><td class=menu><a href=1>m</a></td><td><p>Body text, here.</p><p>More</p></td></tr></table>", "Body text, here.|More"),
        ('<div class="content"><p>Hello, world.</p><div class="ad">Buy!</div><p>Bye</p></div><div class="cookie-banner">We use cookies. Accept, or leave.</div>', "Hello, world.|Bye"),
    ],
)
def test_kinds_of_pages(page, text):
    assert html.main_text(f"<!DOCTYPE html><html><body>{page}</body></html>").split("\n\n") == text.split("|")


def test_rows_of_columns_and_lists_of_sources():
    column = lambda x: "".join(f"<p>{x} {k} has words, commas, and more words, so that it counts for something.</p>" for k in range(9))
    text = lambda x: [f"{x} {k} has words, commas, and more words, so that it counts for something." for k in range(9)]
    rows = "".join(f"<div class=row><div class=col>{column(x)}</div></div>" for x in ("First", "Second"))
    assert html.main_text(f"<html><body><div>{rows}</div><ul><li><a href=1>m</a><li><a href=2>n</a></ul></body></html>").split("\n\n") == text("First") + text("Second")
    sources = "<h2>Sources</h2><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>"
    assert html.main_text(f"<article>{column('Only')}{sources}</article>").split("\n\n") == [*text("Only"), "Sources", "one", "two"]
    assert html.main_text(f"<article>{column('Only')}<nav>{sources}</nav></article>").split("\n\n") == text("Only")


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain &lt;b&gt; & more", "plain <b> & more"), ("<p>a < b", "a < b"), ("<p>a<!-- <p>no</p> -->b", "ab"), ("<article><p>x&nbsp; y</p></article>", "x y"), ("<p title='>'>q</p>", "q"), ("<p>open <b", "open"), ("<article class=comment><p>no</p></article><article><header><h1>H</h1></header><p>yes.</p></article>", "H\n\nyes.")],
)
def test_odd_pages(page, text):
    assert html.main_text(page) == text


HOSTILE = {
    "deep": "<div>" * 200_000 + "x",
    "paragraphs": "<p>a, b</p>" * 100_000,
    "quotes": "<a href='" * 120_000,
    "inline": "<b><p>" * 100_000,
    "comments": "<!-- " * 200_000,
    "lists": "<ul><li>x" * 100_000,
    "tables": "<table><tr><td>x" * 60_000,
    "names": "<title" * 170_000,
    "names that end": "<title" * 170_000 + ">",
    "walls": "<p><button>" + "<div>" * 200_000,
    "ends": "<div>" + "<b>" * 100_000 + "</i>" * 100_000 + "</p>" * 50_000,
    "raw": "<script>" + "</scrip" * 140_000,
    "slashes": "</ " * 300_000 + ">",
    "references": "&amp" * 250_000 + "&#" * 100_000,
    "cells": "<table>" + "<td>x" * 150_000,
    "items": "<ul>" + "<li><p>x" * 100_000,
    "links": "<div><a href=x>y</a>" * 50_000,
    "attributes": "<p " + "a=b " * 250_000 + ">x",
    "names in class": "<p class='" + "ad-x " * 200_000 + "'>x",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    """A megabyte each; seconds allow for a slow machine."""
    began = time.monotonic()
    html.main_text(HOSTILE[kind])
    assert time.monotonic() - began < 8


def test_page_tables(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract(rows).collect()
    assert sorted(((r.text, r.n_chars) for r in got)) == [("", 0), ("a", 1), ("a", 1)]
    assert html.extract(rows.limit(0)).count() == 0


# chats


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a<b"]), st.text(alphabet=st.sampled_from("ab\\[]<>/INSTs \n"), max_size=30) | st.sampled_from(["</s>[INST] ok [/INST]", "[/INST]", "<<SYS>>", "\\"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=6))
def test_round_trip(turns):
    text, spans = chat.Template().text([{"role": r, "text": t} for r, t in turns])
    got = []
    reader = chat.Reader(lambda r, t: got.append((r, t)))
    chat.Template().render([{"role": r, "text": t} for r, t in turns], lambda piece, masked: reader.feed(piece))
    reader.close()
    assert got == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_template_language():
    source = "{# note #}{% set a = 2 * 3 + 1 %}{% for m in messages -%} {{ loop.index ~ ':' ~ m['text'] | upper }}{% if not loop.last %}, {% endif %}{% endfor %} {{ a }} {{ 'x' if 1 < 2 else 'y' }}{% if false %}no{% endif %}"
    assert chat.Template(source).text([{"text": "a"}, {"text": "b"}])[0] == "1:A, 2:B 7 x"


def test_constants_are_folded():
    filters = chat._filters(chat.CONTROLS)
    tree = chat.fold(chat.parse("a{{ 'b' ~ 1 + 2 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ 'd' | upper }}", filters), filters)
    assert tree == [("text", "ab3cD")]


@pytest.mark.parametrize("source", ["{% for %}", "{{ 1 + }}", "{% if a %}", "{{ a | nope }}", "{% endif %}", "{{ f(x) }}", "{% import os %}"])
def test_templates_that_cannot_be_read(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ messages.append }}", "{{ nothing }}", "{{ 'a' * 9 }}"])
def test_sandbox(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source).text([], x="s")


def test_chat_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", "yo", "x"), (None, None, None, None, None), (2, 5, "odd", "t", "x"), (2, 5, "odd", "t", "x")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(rows).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi\nassistant\n\nassistant\nyo\n") and (got[1].loss_chars, got[1].loss_sha256) == (2, sha("yo"))
    assert got[None].turns_sha256 == sha("\n\n") and got[2].n_turns == 2
    texts = {r.conv_id: (r.formatted, [(s.begin, s.end) for s in r.loss]) for r in chat.format_chats(rows).collect()}
    assert texts[1] == ("[INST]hi[/INST]</s>yo</s>", [(19, 21)])
    assert chat.digest(rows.limit(0)).count() == 0


# classifiers


def split_labels(spark, folder):
    labels = table(spark, folder, "labels")
    return labels.where("doc_id % 7 <> 0"), labels.where("doc_id % 7 = 0")


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    train, test = split_labels(spark, folder)
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    chain = toxicity.train(docs, train)
    got = toxicity.score(docs, chain).join(test.select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    y, p = got.y == 1, got.toxic
    assert (y & p).sum() / y.sum() > 0.85 and (~y & p).sum() / (~y).sum() < 0.01
    assert chain.names == ["poor", "toxic"] and (got.p_poor <= 1).all()


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    train, test = split_labels(spark, folder)
    docs = table(spark, folder, "documents")
    got = quality.score(docs, quality.train(docs, train)).join(test.select("doc_id", "quality"), "doc_id").toPandas()
    assert ((got.quality == 1) == got.good).mean() > 0.97


def odd_docs(spark):
    rows = [(1, "a b", "s", "en", 3, 1.0, "x"), (1, "a b", "s", "en", 3, 1.0, "x"), (None, None, None, None, None, None, None), (4, "", "s", "de", -5, 0.0, "x"), (5, "w " * 50_000, "t", "fr", 10**12, 0.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, p_good double, toxic string")


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None), (None, 1, 1), (77, 1, 1)], [(1, 0, 1), (4, 1, 0), (5, 1, 0)], [(1, 7, 7)]])
def test_classifiers_on_odd_tables(spark, labels):
    docs, known = odd_docs(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain, model = toxicity.train(docs, known), quality.train(docs, known)
    assert toxicity.score(docs, chain).count() == 5 and quality.score(docs, model).count() == 5
    assert toxicity.remove(docs, chain).columns == docs.columns == quality.keep_good(docs, model).columns
    if not labels:
        assert toxicity.remove(docs, chain).count() == 5 and quality.keep_good(docs, model).count() == 5
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, known)).count() == 0 and quality.score(empty, quality.train(empty, known)).count() == 0


# the pipeline


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "benchmark decontamination", "sentencepiece"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, DATA).cache()
        kept = {r.doc_id for r in now.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "sentencepiece":
            assert now.columns == docs.columns and now.schema == docs.schema
        if name == "simhash near-dedup":
            assert kept == {r.component_id for r in simhash.near_duplicates(before).collect()}
        if name == "benchmark decontamination":
            assert kept == {r.doc_id for r in decontaminate.annotate(before, table(spark, DATA, "benchmark")).where(~decontaminate.contaminated()).collect()}
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()} == {tuple(r) for r in now.collect()}


def odd_tables(spark, folder, docs, labels=None):
    docs.write.parquet(f"{folder}/documents.parquet")
    (table(spark, DATA, "labels") if labels is None else labels).write.parquet(f"{folder}/labels.parquet")
    table(spark, DATA, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, copies, ids that stand for several texts, and columns named as the operators name theirs."""
    docs = table(spark, DATA, "documents")
    text = "The quiet harbour town keeps its records in order, and every morning the clerk reads them aloud to the council. "
    odd = [(None, None, None, None, None), (None, text * 3, "en", "src1", 300), (7001, text * 3, "en", "src1", 300), (7001, text * 3, "en", "src1", 300), (7001, "Other words " * 20 + "altogether.", "en", "src1", 260), (7002, text * 3, None, None, None), (7003, "", "en", "src2", 0), (7004, None, "de", "src2", 0), (7005, "word " * 100_000, "en", "src3", 500_000)]
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns({"weft_fp": F.lit(1), "y": F.lit("x"), "p_good": F.lit(0.0), "hits": F.lit("z"), "n_tokens": F.lit(9), "weft_row": F.lit(2)})
    folder = odd_tables(spark, tmp_path / "odd", rows)
    now = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, folder).cache()
        assert now.columns == rows.columns and now.count() <= before.count(), name
        if name == "simhash near-dedup":
            known = before.where("doc_id is not null")
            assert now.where("doc_id is null").count() == before.where("doc_id is null").count()
            groups = simhash._grouped(known.select("doc_id", "text"), "doc_id", "text", simhash.RADIUS).where("doc_id is not null").select("root").distinct().count()
            assert now.where("doc_id is not null").count() == groups
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == now.count()


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "a", docs.limit(0))).count() == 0
    few = docs.where("doc_id < 30")
    # without labels nothing is judged; near copies and contaminated documents still go
    assert 0 < corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "b", few, labels.limit(0))).count() <= 30


def test_null_vector_ids(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.01]), (4, [1.0, 0.0]), (5, None)], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.n_links, r.component_id) for r in caps.near_vectors(rows).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, None), (None, 0, None), (3, 1, 3), (4, 1, 3), (5, 0, 5)], key=str)


def test_a_conversation_and_a_turn_of_any_length(spark):
    long = "x [INST] " * 200_000
    rows = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(3000)] + [(2, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(rows).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].n_turns == 3000 and got[1].turns_sha256 == sha("".join(f"{'user' if t % 2 == 0 else 'assistant'}\nturn {t}\n" for t in range(3000)))
    assert got[2].loss_chars == len(long) and got[2].loss_sha256 == sha(long)
