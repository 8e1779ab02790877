import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.tokens import RANKS_PATH, Encoder, count_tokens, decode_documents, encode_documents, read_ranks

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coders():
    with open(RANKS_PATH, "rb") as file:
        ranks = read_ranks(file.read())
    return Encoder(ranks), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = [
    "", " ", "  ", "\n", "a", " a", "  a", "\t a", " \ta", "a  b\n\n c ", "it's we'll I'VE they're 'sup ''s '", "x 's y", "\n's\t't  'd",
    "1's 12'll3", "<|endoftext|> text", "naïve café é", "Привіт, світе! їжак", "日本語テキスト123", "👍🏽 ok 🤷‍♀️", " a  b c", "\x1c a\x85b",
    "don'tt 'lla 'ree 'vex 'md", "....... !!!???", "a" * 3000, "ab" * 2000 + " " * 700 + "x", "​﻿́", "½ ² ٣ Ⅷ", "\U0010ffff",
]


def test_cases_like_the_library(coders):
    own, library = coders
    ids, offsets = own.encode([*CASES, None])
    for text, got, starts in zip([*CASES, ""], ids, offsets, strict=True):
        assert got == library.encode_ordinary(text), repr(text)
        assert (starts[:1] == [0]) == bool(text) and starts == sorted(set(starts))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'strevmld aB1."), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_any_text_like_the_library(coders, texts):
    own, library = coders
    assert own.encode(texts)[0] == [library.encode_ordinary(t) for t in texts]


def test_frames(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "Hello world's end", None), (3, "Hello world's end", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = encode_documents(df, offsets=True).collect()
    assert [r["ids"] for r in out][:2] == [[], []] and out[2]["ids"] == out[3]["ids"] and out[2]["piece_starts"] == [0, 5, 11, 13]
    back = decode_documents(encode_documents(df)).collect()
    assert [r["text"] for r in back] == ["", "", rows[2][1], rows[2][1]]
    assert [r["n_tokens"] for r in count_tokens(df).collect()] == [0, 0, len(out[2]["ids"]), len(out[2]["ids"])]
    assert encode_documents(df.limit(0)).count() == 0
