import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinorst", max_size=60), st.text(alphabet=" \n\t　.=-_1é", max_size=60)))
def test_same_ids(reference, s):
    assert tokenizer.encoder(tokenizer.DEFAULT_VOCABULARY).encode(s) == reference(s)


@pytest.mark.parametrize("s", ["a" * 50_000, "ab" * 30_000, "=" * 40_000, " " * 20_000 + "x", "<|endoftext|> [PAD]", "👩‍🍳�\x00\x7f", "ſtraße İ"])
def test_long_and_odd_texts(reference, s):
    assert tokenizer.encoder(tokenizer.DEFAULT_VOCABULARY).encode(s) == reference(s)


def test_rows(spark, reference):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Two words", 7), (3, "Two words", 7)], "doc_id long, text string, ids int")
    out = sorted((r["doc_id"], list(r["ids"])) for r in tokenizer.encoded(df).collect())
    assert out == [(1, []), (2, []), (3, reference("Two words")), (3, reference("Two words"))]
    assert tokenizer.encoded(df.limit(0)).collect() == []
