import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    ranks = encode.read_ranks(encode.VOCABULARY)
    return encode.Encoder(ranks), tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, texts):
    flat, ends = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60), max_size=5))
def test_equals_the_public_library(tools, texts):
    encoder, public = tools
    assert ids(encoder, texts) == [public.encode_ordinary(t) for t in texts]
    assert encoder.count(texts).tolist() == [len(public.encode_ordinary(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=40))
def test_words_and_round_trip(tools, word):
    encoder, public = tools
    got = ids(encoder, [word])[0]
    assert got == public.encode_ordinary(word) and public.decode(got) == word


def test_pairs_agree_with_exact_merging(tools):
    encoder, _ = tools
    draw = np.random.default_rng(5)
    back = {v: k for k, v in encoder.ranks.items()}
    a, b = draw.integers(0, len(back), 3000), draw.integers(0, len(back), 3000)
    want = [encoder._merged(back[x] + back[y]) == [x, y] for x, y in zip(a, b)]
    assert encoder.compatible(a, b).tolist() == want


def test_cases(tools):
    encoder, public = tools
    long = "ab" * 5000 + " " + "中文" * 3000
    texts = [None, "", " ", "<|endoftext|>", long, "same", "same", "\x00\x1f", "\U0001f600"]
    assert ids(encoder, texts) == [public.encode_ordinary(t) if t else [] for t in texts]
    assert ids(encoder, []) == []


def test_memory_is_emptied(tools, monkeypatch):
    encoder, public = tools
    monkeypatch.setattr(encode, "WORDS_KEPT", 3)
    for t in ("one two three", "four five six seven", "one two"):
        assert ids(encoder, [t]) == [public.encode_ordinary(t)]


def test_table(spark, tools):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (1, "a b", "x"), (None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode.encode_texts(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((i or 0, tools[1].encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert encode.encode_texts(df.where("false"), "doc_id", "text").count() == 0
    counts = encode.count_tokens(df, "text", ["doc_id", "ids"]).collect()
    assert sorted(r.tokens for r in counts) == [0, 0, 1, 2, 2]


def test_a_vocabulary_without_single_bytes_is_refused():
    with pytest.raises(ValueError):
        encode.Encoder({b"a": 0, b"b": 1, b"ab": 2})
