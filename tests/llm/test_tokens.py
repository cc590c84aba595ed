"""Token-id files and the encoder of distinct pieces against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import bpe, tokens
from weftline.llm.common import plain, table
from weftline.sources import files

DATA = "/root/testdata/sf0.001"
ODD = list("abst'mdrelv  \n\t.,-1\u00b2\u00bd\u00a0\u2009\u00e9\u4e2d\u0430\u0130\u1c80\U0001f600\u0085\x1c\x00_\u180e\ua7f2\U00010d4a\u3000\ue000\U000e0001\U0010ffff") + ["'s", "'re", "'ll", " '", "  ", "<|endoftext|>"]


@pytest.fixture(scope="module", params=[False, True])
def encoder(request):
    return bpe.ByteLevel(tokens.tokenizer_path(), request.param)


def lists(encoder, texts):
    ids, first, good = encoder.encode(*plain(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)], good


@settings(deadline=None, max_examples=150)
@given(texts=st.lists(st.lists(st.sampled_from(ODD), max_size=20).map("".join) | st.text(max_size=12), max_size=6))
def test_ids_are_the_librarys(encoder, texts):
    got, good = lists(encoder, texts)
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and good.all()


def test_pieces_that_share_a_hash_and_forgetting(monkeypatch):
    """Pieces are told apart by their bytes; a full cache is forgotten and long pieces are not kept."""
    monkeypatch.setattr(bpe.words, "hashes", lambda low, starts, lengths, seed=0: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    encoder = bpe.ByteLevel(tokens.tokenizer_path(), True)
    for text in ("one two three two one", "x" * 500 + " two", "four five", "one " * 50):
        assert lists(encoder, [text])[0] == [encoder.tokenizer.encode(text, add_special_tokens=False).ids]
        assert all(len(p) <= bpe.CACHE_LONGEST for p in encoder.pieces.number)


@pytest.fixture(scope="module", params=[(0, 1), (1, 1), (5, 1), (3000, 700), (600_000, 40), (600_000, 50_000)])
def shard(request, tmp_path_factory):
    n, kinds = request.param
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(3 / kinds, n) if kinds > 1 else np.full(n, 7), 50_256)
    cuts = np.sort(rng.integers(0, n + 1, 5))
    lengths = np.diff(np.concatenate(([0], cuts, [n])))
    path = str(tmp_path_factory.mktemp("shard") / "one")
    files.write(path, tokens.shard_bytes(ids, pa.array([None, 1, 2, 3, 4, 4]), lengths))
    return ids, lengths, tokens.Shard(path)


def test_shard_answers(shard):
    """Access, counts and occurrences over ranges, and everything in order, as of the plain ids."""
    ids, lengths, opened = shard
    rng = np.random.default_rng(1)
    assert opened.ids().tolist() == ids.tolist() and opened.lengths().tolist() == lengths.tolist()
    assert opened.doc_ids().to_pylist() == [None, 1, 2, 3, 4, 4]
    places = rng.integers(0, len(ids), 2000) if len(ids) else np.zeros(0, np.int64)
    assert opened.access(places).tolist() == ids[places].tolist()
    for token in {*ids[places[:20]].tolist(), 49_999, -1}:
        where = np.flatnonzero(ids == token)
        assert opened.count(token) == len(where) and opened.occurrences(token).tolist() == where.tolist()
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        inside = where[(where >= a) & (where < b)]
        assert opened.count(token, a, b) == len(inside) and opened.occurrences(token, a, b).tolist() == inside.tolist()
    with pytest.raises(IndexError):
        opened.access([len(ids)])


def test_shards_are_smaller_than_plain_ids():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 300_000), 50_000)
    assert len(tokens.shard_bytes(ids, pa.array([1]), np.array([len(ids)]))) < 2 * len(ids)


def plain_result(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    out, at = [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_table(spark):
    got = sorted(map(tuple, tokens.op12_token_files(spark, DATA).collect()))
    assert got == plain_result(sorted((r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()))


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_odd_rows_in_small_shards(spark, tmp_path, most):
    """Nulls, empty and long texts, repeated rows and ids, further columns; files cut after any document."""
    rng = random.Random(3)
    texts = [None, "", "a b", "!", "!!! <|endoftext|>", "word " * 3000, "x" * 5000, "\u00e9\u4e2d"]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts)) for _ in range(60)] + [(5, "a b")] * 20
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string")
    folder = str(tmp_path / "out")
    tokens.write_tokens(docs, folder, tokens_per_file=most)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokens.read_tokens(spark, folder).collect()]
    assert len(got) == len(rows)
    got.sort(key=lambda r: r[1])
    # nulls first, then by id; rows of one id come in any order
    key = lambda i: (i is not None, i or 0)
    assert [key(r[0]) for r in got] == sorted(key(i) for i, _ in rows)
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()
    digest = lambda rs: sorted((key(i), n, c) for i, _, n, c in rs)
    assert digest(got) == digest(plain_result(rows))
    assert len([f for f in files.names(folder) if f.startswith("part-")]) > (1 if most < 1 << 20 else 0)
    with pytest.raises(Exception, match="holds token ids already"):
        tokens.write_tokens(docs, folder)


def test_failed_writes_leave_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(tokens.TokenFiles)
    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("doc_id"), F.expr("if(id = 99, array(cast(raise_error('lost') as int)), array(1, 2))").alias("ids"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format("weft_tokens").mode("append").save(str(tmp_path / "none"))
    assert files.manifest(str(tmp_path / "none")) is None and not files.names(str(tmp_path / "none"))


def test_empty_table(spark, tmp_path):
    docs = table(spark, DATA, "documents").limit(0)
    tokens.write_tokens(docs, str(tmp_path / "empty"))
    assert tokens.read_tokens(spark, str(tmp_path / "empty")).count() == 0
