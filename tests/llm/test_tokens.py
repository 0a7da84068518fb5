import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import tokens as T

PATH = f"{T.FOLDER}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
RANKS = T.load_ranks(PATH) if os.path.exists(PATH) else {}
ENCODER = T.Encoder(RANKS)
TOKENS = sorted(RANKS, key=RANKS.get)


def _other():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    assert T.decode(ENCODER.encode(text), TOKENS) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefgh 0123'\n\t<|>éß中\U0001f600", max_size=60))
def test_equal_to_another_encoder(text):
    assert ENCODER.encode(text) == _other().encode_ordinary(text)


def test_special_looking_text_is_ordinary_and_long_words_are_no_trouble():
    assert 50256 not in ENCODER.encode("a <|endoftext|> b")
    began = time.time()
    assert T.decode(ENCODER.encode("ab" * 100_000), TOKENS) == "ab" * 100_000
    assert time.time() - began < 20


def test_corpus(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (4, "Hello world", "x"), (4, "Hello world", "x"), (5, "word " * 50_000, "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], tuple(r["ids"])) for r in T.encode_corpus(df).collect()), key=str)
    want = sorted(((d, tuple(ENCODER.encode(t))) for d, t, _ in rows), key=str)
    assert got == want
    assert {r["doc_id"]: r["text"] for r in T.round_trip(df).collect()}[5] == rows[5][1]
    assert T.encode_corpus(df.limit(0)).collect() == []
