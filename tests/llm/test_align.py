"""Alignment of two tokenizers against plain code over the libraries' tokens."""

import collections
import hashlib
import random

import numpy as np
import pytest

from weftline.llm import align, sentencepiece
from weftline.llm.common import table
from weftline.llm.packing import packed_numbers, unpacked_numbers
from weftline.llm.tokens import tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece as spm
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, spm.SentencePieceProcessor(model_file=sentencepiece.model_path())


def plain_groups(libraries, text):
    """Groups and links of one text, token by token; None without tokens."""
    from weftline.llm.bpe import token_bytes

    a, b = libraries
    whole = b" " + (text or "").encode()
    ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    bytes_a = token_bytes(a)
    parts_a = [bytes_a[i] for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
    if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return None
    groups, links, i, j, at_a, at_b = [([], [])], [], 0, 0, 0, 0
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        end_a, end_b = at_a + len(parts_a[i]), at_b + len(parts_b[j])
        if end_a <= end_b:
            groups[-1][0].append(ids_a[i])
            i, at_a = i + 1, end_a
        if end_b <= end_a:
            groups[-1][1].append(ids_b[j])
            j, at_b = j + 1, end_b
        if end_a == end_b:
            groups.append(([], []))
    return ids_a, ids_b, groups[:-1], links


def plain_result(libraries, rows):
    found = [(i, plain_groups(libraries, t)) for i, t in rows]
    counts = collections.Counter(p for _, f in found if f for p in set(f[3]))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[p] == best[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_table(spark, libraries):
    got = align.op13_alignment(spark, DATA).collect()
    assert ordered(got) == ordered(plain_result(libraries, [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]))


ODD = list("abst'mdrelv  \n\t.,-1\u00b2\u00bd\u00a0\u00e9\u4e2d\u0430\U0001f600\x00\u2581") + ["'s", " '", "  ", "<|endoftext|>", "</s>", "<s>", "<0x41>", " " * 20]


@pytest.mark.parametrize("chunk", [1, 60, align.CHUNK])
def test_odd_rows_in_small_chunks(spark, libraries, chunk):
    """Nulls, empty and long texts, texts that are not given back, repeated rows and ids, clashing names, any chunks."""
    rng = random.Random(chunk)
    texts = [None, "", " ", "a", "\u2581", "word " * 2000, "x" * 3000, "a copy that is very common"]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts) if rng.random() < 0.4 else "".join(rng.choices(ODD, k=rng.randrange(30)))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, chunk int, pairs string, `a.b` double")
    got = align.alignment_counts(docs, chunk=chunk)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(plain_result(libraries, rows))
    assert align.alignment_counts(docs.limit(0)).count() == 0


def test_groups_are_given_out(spark, libraries):
    rows = [(1, "The quiet harbour's town, 1234!"), (2, None), (3, "\u2581"), (None, "\u00e9\u4e2d \U0001f600"), (4, "")]
    for r in align.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = plain_groups(libraries, dict(rows)[r.doc_id])
        if want is None:
            assert r.a_ids == r.b_ids == r.a_ends == r.b_ends == []
            continue
        cut = lambda ids, ends: [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert (r.a_ids, r.b_ids) == want[:2] and list(zip(cut(r.a_ids, r.a_ends), cut(r.b_ids, r.b_ends), strict=True)) == [tuple(g) for g in want[2]]


def test_pairs_are_shuffled_once_a_chunk(spark):
    """A pair that every document holds is one row for each chunk, not one for each document."""
    rows = align._chunks(spark.range(5000).selectExpr("id as doc_id", "'all say the same' as text").coalesce(2), *align._paths(None, None), align.CHUNK)
    kept = rows.where("pairs is not null").collect()
    assert len({r.chunk for r in kept}) == len(kept) <= 2 and sum(r.documents[0] for r in kept) == 5000


@pytest.mark.parametrize("values", [[], [0], [127, 128, 0, 1], [2**40, 5, 2**14 - 1, 2**14, 2**55]])
def test_packed_numbers(values):
    data, ends = packed_numbers(np.array(values, np.int64))
    assert unpacked_numbers(data).tolist() == values and len(ends) == len(values) and (not values or ends[-1] == len(data))


def test_sums_beyond_doubles():
    assert not align.max_exact(np.array([2**40]), np.array([2**20]))
    assert align.exact(np.array([0, 0]), np.array([2**60, 1]), 1).tolist() == [2**60 + 1]
