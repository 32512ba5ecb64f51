import random

import pytest
import tiktoken

from marginalia.llm import bpe

TEXTS = ["", " ", "Hello, world!", "It's  1234.5 — naïve café\n\n\tx", "a" * 1000, "日本語テスト" * 100, "🙂👩‍👩‍👧" * 50, "<|endoftext|> plain", "\x00\x01", "x" * 257, "ab" * 3000]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


def test_ids_equal_those_of_a_reference_encoder(spark, ranks):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("abcdefgh é.\n'1") for _ in range(rng.randrange(400))) for _ in range(80)] + ["".join(rng.choice("etaoin") for _ in range(2000))]
    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = {r.doc_id: r for r in bpe.encoded(df).collect()}
    for i, text in enumerate(texts):
        assert rows[i].ids == known.encode_ordinary(text)
        assert rows[i].restored and rows[i].n_ids == len(rows[i].ids)
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert back == dict(enumerate(texts))


def test_long_words_merge_as_short_ones_do(ranks):
    vocabulary = bpe.Vocabulary(ranks)
    rng = random.Random(1)
    for _ in range(50):
        word = bytes(rng.choice(b"aehnst ") for _ in range(rng.randrange(2, 200)))
        ids, count = vocabulary.encode_words([word])
        assert ids.tolist() == vocabulary.encode_long(word).tolist() and count.tolist() == [len(ids)]


def test_small_vocabulary_merges_leftmost_least_rank_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    vocabulary = bpe.Vocabulary(ranks)
    assert vocabulary.encode_words([b"abc"])[0].tolist() == [258]
    assert vocabulary.encode_words([b"aaa", b"", b"bcab"])[0].tolist() == [259, 97, 257, 256]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (3, "y", 0), (3, "y", 0)], "doc_id long, text string, ids int")
    rows = sorted(bpe.encoded(df).collect(), key=lambda r: str(r))
    assert [(r.doc_id, r.n_ids, r.restored) for r in sorted(rows, key=lambda r: (r.doc_id or 0))] == [(None, 1, True), (1, None, None), (2, 0, True), (3, 1, True), (3, 1, True)]
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df.where("doc_id < 3"))).collect()} == {1: None, 2: ""}
