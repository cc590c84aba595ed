"""SentencePiece, decontamination, SimHash and language-model scores against brute force."""

import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, sentencepiece, simhash
from weftline.llm.common import components, join_unique, table

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def lowered(t):
    return (t or "").translate(LOWER)


def docs(spark, texts, ids=None):
    """A table with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, 1, "x", 2, "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, items string, fp int, ids string")


ODD = ["", None, " ", "a", "  a  b ", "é É ß", "日本 語の テキスト", "🎉🎉 ok", "\x00\t\n\r", "▁▁ x▁y", "<s> </s> <unk> <0x41>", "word " * 3000, "x" * 5000, " " * 40 + "the", "\ufeff\u200d�"]


# components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for n in {x for e in edges for x in e}:
        assert got.get(n, n) == find(n)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def library():
    spm = pytest.importorskip("sentencepiece")
    return spm.SentencePieceProcessor(model_file=sentencepiece.model_path())


@pytest.fixture(scope="module")
def model():
    return sentencepiece.Model(open(sentencepiece.model_path(), "rb").read())


def test_ids_are_the_librarys(library, model):
    rng = random.Random(1)
    alphabet = "  ▁aehtnirsoxyzABC019.,;é日🎉\n\t-_/="
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(1500)] + ["ab" * 300 + "th" * 200, "a" * 999, " " * 500]
    got = model.encode(texts)
    assert got == library.encode(texts, add_eos=True)
    assert [model.decode(g) for g in got] == library.decode(got)


def test_decoding_of_any_ids(library, model):
    rng = random.Random(2)
    lists = [[rng.randrange(32000) for _ in range(rng.randint(0, 8))] for _ in range(500)] + [[rng.randrange(3, 259) for _ in range(rng.randint(1, 12))] for _ in range(1000)] + [[1, 2, 28705, 300], [259, 300]]
    assert [model.decode(x) for x in lists] == [library.decode(x) for x in lists]


def unbroken(library, seed, n):
    rng = random.Random(seed)
    pieces = [p.replace("▁", "") for p in (library.id_to_piece(i) for i in range(300, 32000)) if p.isalpha()]
    return {
        "letters": "".join(rng.choice("abcdefgh") for _ in range(n)),
        "all letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFéüñ") for _ in range(n)),
        "pieces": "".join(rng.choice(pieces) for _ in range(n // 5)),
        "one": "a" * n,
        "two": "ab" * (n // 2),
        "runs": "".join(rng.choice("abeo") * rng.randint(1, 40) for _ in range(n // 20)),
        "dashes": "".join(rng.choice("-=_*") * rng.randint(1, 60) for _ in range(n // 30)),
        "odd": "".join(rng.choice("th🎉日éer<0x41>") for _ in range(n)),
    }


@pytest.mark.parametrize("n", [40, 300, 3000])
def test_unbroken_texts_are_the_librarys(library, model, n):
    for seed in range(6):
        for name, text in unbroken(library, seed, n).items():
            assert model.encode([text])[0] == library.encode(text, add_eos=True), (name, seed)
    texts = [t for seed in range(6) for t in unbroken(library, seed, n).values()]
    assert model.encode([" ".join(texts)])[0] == library.encode(" ".join(texts), add_eos=True)


def test_a_million_letters_take_seconds(library, model):
    for name, text in unbroken(library, 5, 1_000_000).items():
        began = time.monotonic()
        got = model.encode([text])[0]
        assert time.monotonic() - began < 25, name
        assert got == library.encode(text, add_eos=True), name


def test_memory_of_words_is_bounded(library, model):
    """Long unbroken words are not kept from block to block, and short ones only up to a number of bytes."""
    cache = sentencepiece.Words()
    rng = random.Random(1)
    for _ in range(3):
        text = "".join(rng.choices("abcdefgh", k=5000))
        assert model.encode([text], cache) == [library.encode(text, add_eos=True)]
        assert not len(cache) and len(cache.block) == 1
    model.encode(["a few words"], cache)
    assert 0 < len(cache) and not cache.block and cache.bytes > 0
    cache.bytes = sentencepiece.CACHE_BYTES + 1
    model.encode(["others"], cache)
    assert "few" not in "".join(cache) and cache.bytes < 10_000


def test_sentencepiece_tables(spark, library):
    rows = docs(spark, ODD + ODD[:3], [*range(len(ODD)), 0, 0, None])
    encoded = sentencepiece.encode(rows)
    back = {r.doc_id: r.text for r in sentencepiece.decode(encoded).where("doc_id > 3").collect()}
    want = {i: library.decode(library.encode(t)) for i, t in enumerate(ODD) if i > 3}
    assert back == want
    digest = sentencepiece.digest(rows).collect()
    assert len(digest) == len(ODD) + 3
    for r in digest:
        if r.doc_id is not None and r.doc_id > 0:
            ids = library.encode(ODD[r.doc_id] or "", add_eos=True)
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece.digest(rows.limit(0)).count() == 0


# decontamination


def brute(texts, items, window=13):
    wins = collections.defaultdict(set)
    for i, x in items:
        w = WORDS.findall(lowered(x))
        k = min(window, len(w))
        for j in range(len(w) - k + 1) if k else ():
            wins[tuple(w[j : j + k])].add(i)
    out = []
    for t in texts:
        w, hit, met = WORDS.findall(lowered(t)), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if (s := wins.get(tuple(w[p : p + k]))) is not None:
                    hit.update(range(p, p + k))
                    met |= s
        out.append((len(w), len(hit), sorted(str(i) for i in met if i is not None)))
    return out


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


LONG = " ".join(f"w{k}" for k in range(40))
ITEMS = [(1, LONG), (2, "the cat"), (3, "THE"), (10, None), (11, " !? "), (None, "secret words"), (12, " ".join(["aa"] * 20)), (13, "É x É")]
TEXTS = [*ODD, f"before {LONG.upper()} after", " ".join(LONG.split()[5:18]), " ".join(LONG.split()[5:17]), "a the-cat!", "aa " * 500, "secret words", "é x É É X É", "w1 " + "z " * 30]


def test_decontamination_is_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.annotate(docs(spark, TEXTS), bench(spark, ITEMS)).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS, ITEMS)


def test_benchmark_in_several_passes(spark):
    rows = docs(spark, TEXTS)
    one = sorted(map(tuple, decontaminate.annotate(rows, bench(spark, ITEMS)).collect()))
    many = sorted(map(tuple, decontaminate.annotate(rows, bench(spark, ITEMS), most=20).collect()))
    assert [(*r[:3], list(r[3])) for r in one] == [(*r[:3], list(r[3])) for r in many]


def test_longest_matches(spark):
    text = "x " + " ".join(LONG.split()[3:33]) + " y " + " ".join(LONG.split()[0:13])
    got = sorted(tuple(r)[1:] for r in decontaminate.matches(docs(spark, [text]), bench(spark, ITEMS[:1])).collect())
    assert got == [(1, 30, 1, 3), (32, 13, 1, 0)]


def test_removal_keeps_columns_and_clean_rows(spark):
    rows = docs(spark, TEXTS)
    kept = decontaminate.remove(rows, bench(spark, ITEMS))
    assert kept.columns == rows.columns
    want = [i for i, (n, h, _) in enumerate(brute(TEXTS, ITEMS)) if not (h and 20 * h >= n)]
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert decontaminate.remove(rows, bench(spark, ITEMS).limit(0)).count() == len(TEXTS)
    assert decontaminate.annotate(rows.limit(0), bench(spark, ITEMS)).count() == 0


# SimHash


def plain_fingerprint(t):
    import xxhash

    w = SPACED.findall(lowered(t))
    s = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_groups(fps, ids):
    low = dict(enumerate(ids))
    for _ in fps:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
        if not changed:
            break
    return [low[i] for i in range(len(ids))]


def test_simhash_is_brute_force(spark):
    texts = [r.text for r in table(spark, DATA, "documents").orderBy("doc_id").limit(120).collect()] + ODD
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == plain_groups(fps, list(range(len(texts))))


@pytest.mark.parametrize(("leaf", "chunk"), [(512, 4096), (16, 8)])
def test_trees_find_every_link(spark, leaf, chunk):
    """Clusters around a few centres, so that balls cross boundaries and leaves are dealt out."""
    rng = random.Random(9)
    fps = {0}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) % 2**64)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), leaf=leaf, chunk=chunk, sample=100)
    got = {r.node: r.root for r in components(found).collect()}
    want = plain_groups(fps, signed)
    same = collections.defaultdict(set)
    for f, w in zip(signed, want, strict=True):
        same[w].add(got.get(f, f))
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


def test_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"tok{k}" for k in range(60))
    rows = docs(spark, [text, text, "other words are here", "", None, text, text], [5, 3, 8, 9, 2, None, 3])
    kept = simhash.dedup(rows)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id is None, r.doc_id) for r in kept.collect())) == [(False, 2), (False, 3), (False, 8), (True, None)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[5, 3, 8, None], [5, 5, 8, None]])
def test_dedup_with_clashing_names(spark, ids):
    """Columns named as the operator names its own, or with dots and quotes in their names."""
    text = " ".join(f"tok{k}" for k in range(60))
    names = {"weft_fp": 1, "weft_row": 2, "id": 4, "root": 5, "a.b": 6, "c`d": 7, "component_id": 8}
    rows = docs(spark, [text, text, "other words are here", text], ids).withColumns({"x": F.lit(0)})
    rows = rows.select("*", *(F.lit(v).alias(k) for k, v in names.items()))
    kept = simhash.dedup(rows)
    assert kept.columns == rows.columns
    got = kept.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == [(False, min(ids[:2])), (False, 8), (True, None)]
    assert all(r[k] == v for r in got for k, v in names.items())


def test_dedup_judges_rows_of_one_id_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in ("tok", "word", "other"))
    kept = lambda texts, ids: sorted((r.doc_id, r.text) for r in simhash.dedup(docs(spark, texts, ids)).collect())
    assert kept([a, b, b], [5, 5, 3]) == [(3, b), (5, a)]
    assert kept([a, c, c], [5, 5, 5]) == sorted([(5, a), (5, c)])


def plain_dedup(rows):
    """Of each group of rows that link, directly or by others, and rows of one id and text, one stays; null ids stay."""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(fps, list(range(len(rows))))
    out = [(i, t) for i, t in rows if i is None]
    for g in set(group):
        members = [(i, t) for (i, t), k in zip(rows, group, strict=True) if k == g and i is not None]
        if members:
            least = min(i for i, _ in members)
            out.append((least, {t for i, t in members if i == least}))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dedup_is_brute_force(spark, seed):
    """Ids that stand for several texts, copies, null ids and texts: exactly one row of each group, and none lost."""
    rng = random.Random(seed)
    texts = [" ".join(f"{x}{k}" for k in range(40)) for x in ("tok", "word", "other", "more")] + ["", None, "a b", " ", "a  b "]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice(texts)) for _ in range(30)]
    kept = [(r.doc_id, r.text) for r in simhash.dedup(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()]
    want = plain_dedup(rows)
    known = [(i, t) for i, t in kept if i is not None]
    assert sorted(map(str, (k for k in kept if k[0] is None))) == sorted(map(str, (w for w in want if w[0] is None)))
    groups = [w for w in want if w[0] is not None]
    assert len(known) == len(groups)
    for i, some in groups:
        assert sum(k[0] == i and k[1] in some for k in known) == 1


def test_hot_keys_meet_in_a_broadcast(spark):
    left = spark.range(5000).selectExpr("if(id < 4000, 7, id) as k", "id").cache()
    right = spark.range(6000).selectExpr("id as k", "id * 2 as v").cache()
    found = join_unique(left, right, "k")
    assert found.count() == 5000 and found.where("v <> 2 * k").count() == 0
    assert found.select("id").distinct().count() == 5000
    assert join_unique(left.limit(0), right, "k").count() == join_unique(left, right.limit(0), "k").count() == 0
