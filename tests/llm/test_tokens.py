import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm.tokens import VOCABULARY, decoded, encoded, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXT = st.one_of(st.text(max_size=80), st.text("ab the in0é ß\n\t=-zz'sΩ", max_size=120), st.lists(st.sampled_from([" the", "ing", "    ", "tion", "0", "'s", "‍", "🙂", "<|endoftext|>", "ЖЖ"]), max_size=30).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_equals_the_public_tokenizer_and_round_trips(text):
    own = encoder(VOCABULARY)
    ids = own.encode(text)
    assert ids == public_().encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


_kept = []


def public_():
    if not _kept:
        _kept.append(public())
    return _kept[0]


def test_long_words_are_linear_and_right():
    own = encoder(VOCABULARY)
    for text in ("a" * 30_000, "ab" * 10_000, "  " * 5_000, "nachgemacht" * 2_000):
        assert own.encode(text) == public_().encode(text, add_special_tokens=False).ids


def test_encoded_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "   ", "x"), (4, "<|endoftext|> hi", None), (4, "<|endoftext|> hi", None), (None, "a", "x"), (5, "long text " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = encoded(df, "doc_id", "text")
    got = {r.key: r.ids for r in out.collect()}
    assert got[1] == [] and got[2] == [] and len(out.collect()) == len(rows)
    assert got[4] == public_().encode("<|endoftext|> hi", add_special_tokens=False).ids
    back = {r.key: r.text for r in decoded(out, "key", "ids").collect()}
    assert all(back[k] == (t or "") for k, t, _ in rows)
    assert encoded(df.limit(0), "doc_id", "text").count() == 0
