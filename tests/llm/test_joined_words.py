"""Words go to the library many at a time; a worker keeps no block of the language model."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from weftline.llm import bpe, lm


@pytest.mark.parametrize("plain", [True, False])
def test_joined_words_have_their_own_ids(plain):
    made = bpe.ByteLevel(str(public_tokenizers.path("byte_bpe_50k.json")), plain)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCZéßñЖдאبकम漢字ぁ한ǅʰ"
    pieces = [" " + "".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(3000)]
    pieces += [" ", "  ", " a b", "a", "\n", " 1", " a1", "'s", " 's", "<|endoftext|>", " <|endoftext|>", "", " é", " ͸", " x", " x y", " " + "long" * 500]
    rng.shuffle(pieces)
    calls = []
    each = made._each
    made._each = lambda texts: calls.append(len(texts)) or each(texts)
    got = made._encode([p.encode() for p in pieces])
    assert got == [made.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]
    assert sum(calls) < 100


def test_words_whose_tokens_do_not_fit_are_encoded_alone():
    made = bpe.ByteLevel(str(public_tokenizers.path("byte_bpe_50k.json")), True)
    want = made._encode([b" one", b" two"])
    made.widths = made.widths + 1
    assert made._words([" one", " two"], [4, 4]) is None and made._encode([b" one", b" two"]) == want


def test_workers_free_their_block(spark):
    """Workers kept the last block for the next model, whose counting needs the room."""
    docs = spark.createDataFrame([(i, f"a b c{i % 5} d") for i in range(200)], "doc_id long, text string")
    lm.score(docs).collect()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(lm._held)], pa.int32())})

    assert [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n int").collect()] == [0] * 8
