import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from sparvex.llm.tokenize import Encoder, MinimalPerfectHash, default_vocabulary, encode  # noqa: E402


@pytest.fixture(scope="module")
def encoder():
    with open(default_vocabulary(), "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_the_library(encoder, library):
    random.seed(2)
    parts = ["'", "s", "t", "re", "ll", "don't", " ", "  ", "\n", "\t", "\r\n", "a", "é", "ß", "中", "1", "²", " ", "　",
             "\x1c", "\x85", "​", "!", "<|endoftext|>", "😀", "́", "''", "﻿", "𝟙", "\U00020000"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, "ab1 " * 20000, "x" * 50000]
    assert encoder.encode_arrow(pa.array(texts)).to_pylist() == library(texts)


def test_sliced_and_null_arrays(encoder, library):
    a = pa.array(["first", None, "", "the third text"]).slice(1, 3)
    assert encoder.encode_arrow(a).to_pylist() == [[], [], *library(["the third text"])]
    assert encoder.encode_arrow(pa.array([], pa.string())).to_pylist() == []
    assert encoder.encode_arrow(pa.array([None], pa.string())).to_pylist() == [[]]


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(MinimalPerfectHash(keys)(keys).tolist()) == list(range(len(keys)))


def test_encode_table(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode(df).collect())
    hello = library(["Hello world"])[0]
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    assert encode(df.limit(0)).count() == 0
