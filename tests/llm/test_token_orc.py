import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scenelake.llm import token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def written(odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tokens"))
    token_orc.write_tokens(odd, folder, slices=3)
    return folder


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in rows]


def test_round_trip(spark, odd, written):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0]))
    got = token_orc.read_tokens(spark, written).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(map(tuple, expected(t for _, t in rows)))
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
    for r, c in zip(got, token_orc.checksums(token_orc.read_tokens(spark, written)).orderBy("start").collect(), strict=True):
        assert (c.doc_id, c.start, c.n_tokens) == (r.doc_id, r.start, len(r.ids))
        assert c.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_pieces_are_those_of_the_whole_text():
    texts = ["", "  ", " a", "a ", " \n b", "a \nb", "a\n b", "a\n\n b \n", "x <|endoftext|> y", "it's we'll 12 3",
             "  a  b", "\x1c a\x1cb \x85 c", "é 日本 🙂 x", "a \xa0 \xa0 b", "a\xa0 ", "a\xa0 <|endoftext|> b", "a \n"]
    for _ in range(2):
        assert encoded(token_orc.encoder(PATH), texts) == expected(texts)


def encoded(encoder, texts):
    flat, counts = encoder(pa.array(texts, pa.string()))
    return [x.tolist() + [2] for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_all_blanks():
    """Random texts over every blank of Unicode and Python, beside words, marks and the added token."""
    draw = random.Random(11)
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff"]
    others = ["a", "word", "'s", "12", ".", "é", "日", "🙂", "<|endoftext|>", "$", "\n", "'", "'ll", "\u0301"]
    for added in (True, False):
        encoder, tokenizer = token_orc.Encoder(PATH, added), Tokenizer.from_file(PATH)
        tokenizer.encode_special_tokens = not added
        for _ in range(50):
            texts = [
                "".join(draw.choice(draw.choice([[" "], blanks, others, others[:4]])) for _ in range(draw.randrange(12)))
                for _ in range(200)
            ]
            want = [x.ids + [2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert encoded(encoder, texts) == want


def test_forgotten_words(monkeypatch):
    """A memory far too small changes nothing but the time."""
    monkeypatch.setattr(token_orc, "REMEMBERED", 6)
    encoder = token_orc.Encoder(PATH)
    for i in range(40):
        texts = [f"some words and number {i % 7} again {i}", "the same words", ""]
        assert encoded(encoder, texts) == expected(texts)


def test_metadata(spark, written):
    import glob

    files = sorted(glob.glob(f"{written}/shards/*.orc"))
    assert files and sum(orc.ORCFile(f).nrows for f in files) == 12
    pruned = token_orc.read_tokens(spark, written, "doc_id = 6")
    assert [r.doc_id for r in pruned.collect()] == [6]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)" in pruned._jdf.queryExecution().toString()


def test_empty(spark, none, tmp_path):
    token_orc.write_tokens(none, str(tmp_path / "t"), slices=2)
    assert token_orc.checksums(token_orc.read_tokens(spark, str(tmp_path / "t"))).count() == 0
