import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scenelake.llm import pieces

MODEL = pieces.load()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def both(texts, rate, keys=None):
    """Ids by arrays, after a check that the heap gives the same."""
    keys = np.arange(len(texts)) if keys is None else keys
    got = [x.tolist() for x in pieces.encode_batch(MODEL, texts, keys, rate)]
    long, pieces.LONG = pieces.LONG, 0
    try:
        assert got == [x.tolist() for x in pieces.encode_batch(MODEL, texts, keys, rate)]
    finally:
        pieces.LONG = long
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_lossless(texts, rate):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [pieces.decode(MODEL, x) if x else "" for x in both(texts, rate)] == texts


def test_without_dropout_as_the_library():
    texts = ["Hello  world x\n\t a", " lead", "a<s>b</s>", "é€🙂 ﬁ", "trail  ", "   ", "a" * 500, "日本語テキスト" * 20, "naïve co-operation"]
    assert both(texts, 0.0) == [LIBRARY.encode(t) for t in texts]


def test_dropout_varies_by_key_and_repeats():
    text = "international cooperation between universities and laboratories"
    a, b = both([text, text], 0.3)
    assert a != b and both([text], 0.3, np.array([1])) == [b]
    assert len(both([text], 1.0)[0]) == len(text) + 1 and len(a) > len(both([text], 0.0)[0])
    drawn = [len(x) for x in both([text] * 300, 0.1)]
    assert len(set(drawn)) > 3


@pytest.mark.parametrize("rate", [0.0, 0.1])
def test_tables(odd, none, rate):
    encoded = pieces.encode(odd, rate)
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert sorted((r.doc_id or 0, r.text) for r in pieces.decoded(encoded).collect()) == texts
    rows = pieces.round_trip(odd, rate).collect()
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    assert pieces.encode(none).count() == 0 and pieces.round_trip(none).count() == 0
