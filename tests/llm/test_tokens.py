import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plenaria.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabularies")


@pytest.fixture(scope="module")
def both():
    ranks = tokens.load()
    return tokens.Bpe(ranks), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "De regering wordt verzocht.", "  twee  spaties \n\n\t", "é½🙏🏽�​", "<|endoftext|>", "'s 'T we'll", "ab" * 3_000, "1234567890" * 50, "\x00\x01", "好的"]


@pytest.mark.parametrize("text", TEXTS, ids=lambda t: repr(t)[:20])
def test_equals_the_library_and_decodes(both, text):
    own, library = both
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    own = _own()
    assert own.decode(own.encode(text)) == text


def _own(cache={}):
    if "b" not in cache:
        r = tokens.load()
        cache["b"] = tokens.Bpe(r)
        cache["l"] = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=r, special_tokens={})
    return cache["b"]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merges_of_any_bytes(data):
    own = _own()
    ids = own.encode_word(data)
    assert b"".join(own.strings[i] for i in ids) == data


def test_table(spark, both):
    df = spark.createDataFrame([(1, "De motie.", 7), (2, "", 7), (3, None, 7), (1, "De motie.", 7)], "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode(df, "text").collect()]
    want = both[1].encode_ordinary("De motie.")
    assert got == [(1, want), (2, []), (3, []), (1, want)]
    back = tokens.decode(tokens.encode(df, "text"), "ids", "back").select("text", "back").collect()
    assert all((r.text or "") == r.back for r in back)
    assert [r.n_tokens for r in tokens.count(df, "text").collect()] == [len(want), 0, 0, len(want)]
    assert tokens.encode(df.limit(0), "text").count() == 0


def test_whole_corpus_by_another_vocabulary(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    ranks = tokens.load(name="byte_bpe_multi_50k")
    library = tiktoken.Encoding("m", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in tokens.encode(d, "text", name="byte_bpe_multi_50k").collect():
        assert list(r.ids) == library.encode_ordinary(r.text or "")
