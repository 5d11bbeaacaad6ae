import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
PATH = f"{bpe.TOKENIZER_DIR}/{bpe.BYTE_BPE_50K}"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    v = bpe.load_vocabulary(PATH)
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert bpe.Encoder(v).encode([text])[0] == enc.encode_ordinary(text)


def test_hard_words(vocabulary, reference):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeinorst") for _ in range(r.randrange(1, 25))) for _ in range(3000)] + ["a" * 300, "の" * 50, " " * 40 + "x", "<|endoftext|>", "0" * 70]
    assert bpe.Encoder(vocabulary).encode(words) == [reference.encode_ordinary(w) for w in words]


def test_other_vocabulary():
    v = bpe.load_vocabulary(f"{bpe.TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("m", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    texts = ["Größe über alles, déjà vu", "市场价格上涨。", "the moving averages"]
    assert bpe.Encoder(v).encode(texts) == [enc.encode_ordinary(t) for t in texts]


def test_columns(spark, reference):
    long = "word and more; " * 40_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (4, long, "x"), (5, "  \t\r\n", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id").collect())
    ids = dict(got)
    assert len(got) == 6 and ids[1] == ids[2] == [] and ids[3] == reference.encode_ordinary("Hello world") and ids[4] == reference.encode_ordinary(long)
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()}
    assert n[1] == 0 and n[4] == len(ids[4])
    assert bpe.encode_column(df.limit(0), "doc_id").collect() == []


def test_cache_overflow(vocabulary, monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    e = bpe.Encoder(vocabulary)
    texts = ["one two three four five six seven", "eight nine ten one two"]
    assert [e.encode([t])[0] for t in texts] == [reference.encode_ordinary(t) for t in texts]
