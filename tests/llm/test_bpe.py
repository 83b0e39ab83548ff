import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from strandloom.llm import bpe

from ..helpers import rows_by

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.Encoder(bpe.Vocabulary.read(PATH), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_documents(both, docs_001):
    for text in docs_001:
        assert ids(both[0], text) == both[1].encode_ordinary(text)
        assert both[0].decode(both[0].encode(text)) == text.encode()


def test_random_texts(both):
    rnd = random.Random(2)
    parts = ["a", "b", "ab", "the", "  ", "\n", "1", "é", "ß", "ing", "zz", "日本", "😀", "'s", "²", "½", "\x1c", " ", "<|endoftext|>", "_", "ª"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))
        assert ids(both[0], text) == both[1].encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 5_000, "!" * 20_000, "aé" * 5_000, "zq" * 30_000])
def test_long_pieces(both, text):
    assert ids(both[0], text) == both[1].encode_ordinary(text)


def test_small_vocabulary_with_backtracking():
    ranks = {bytes([x]): k for k, x in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5}
    encoder, plain = bpe.Encoder(bpe.Vocabulary(ranks), "[abc]+"), tiktoken.Encoding("own", pat_str="[abc]+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    for _ in range(500):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 20)))
        assert ids(encoder, text) == plain.encode_ordinary(text)


def test_edge_rows(spark, both):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "hi there", 7), (2, "", 6)], "doc_id bigint, text string, n_tokens int")
    out = rows_by(bpe.encode_and_decode(df, PATH, P.PATTERN, with_ids=True), "doc_id")
    assert len(out[2]) == 2 and out[1][0].n_tokens == 0 and out[1][0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[None][0].ids == both[1].encode_ordinary("hi there") and out[None][0].decoded_sha256 == hashlib.sha256(b"hi there").hexdigest()
    assert bpe.encode_and_decode(df.limit(0), PATH, P.PATTERN).count() == 0
