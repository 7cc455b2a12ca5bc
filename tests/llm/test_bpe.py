import hashlib

import public_tokenizers
import pytest
import tiktoken

from fathom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


TEXTS = ["", " ", "a", "\n\n  x", "It's 12345 o'clock, naïve café — 東京 🙂🙂", "a" * 3000, "ab" * 1500 + " \t\r\n", "<|endoftext|>", "é" * 777, "x y z", "0123456789" * 50, "The the THE"]


def test_ids_equal_the_library_and_round_trip(peer):
    codec = bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    for text in TEXTS:
        ids = codec.encode(text)
        assert ids == peer.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_many_random_pieces_equal_the_library(peer):
    import random

    rng = random.Random(5)
    codec = bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    texts = [" ".join("".join(rng.choices("etaoinshrdlé", k=rng.randint(1, 90))) for _ in range(60)) for _ in range(50)]
    assert list(codec.encode_all(texts)) == [peer.encode_ordinary(x) for x in texts]


def test_query_on_odd_rows(spark, peer):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[4], TEXTS[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        ids = peer.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_columns(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    encode, decode = (f(spark, PATH, public_tokenizers.PATTERN) for f in (bpe.encode_column, bpe.decode_column))
    out = docs.select("doc_id", decode(encode("text")).alias("b")).orderBy("doc_id").collect()
    assert [bytes(r.b) for r in out] == [b"one two", b""]


def test_long_texts_and_a_null_key(spark, peer):
    rows = [(1, "the quick brown fox " * 30_000), (2, "x" * 100_000), (None, "été " * 50_000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_tokens) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = sorted(((i, len(peer.encode_ordinary(t or "")) if i != 2 else len(bpe.merge_piece(b"x" * 100_000, bpe.load_ranks(PATH)))) for i, t in rows), key=str)
    assert got == want
