import zlib

import numpy as np
import pytest

from scenelake.llm import language

TEXTS = {
    "en": "the house and the garden of the old man were with that which they have seen there",
    "de": "das haus und der garten von dem alten mann waren mit dem was sie nicht gesehen haben",
    "fr": "la maison et le jardin du vieil homme étaient avec ce que nous avons vu dans les rues",
    "es": "la casa y el jardín del hombre viejo estaban con lo que ellos han visto en las calles",
}


@pytest.fixture(scope="module")
def labelled(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(400):
        lang = list(TEXTS)[i % 4]
        rows.append((i, " ".join(draw.choice(TEXTS[lang].split(), 12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(labelled):
    got = {r.doc_id: r for r in language.identify(labelled).collect()}
    want = {r.doc_id: r.lang for r in labelled.collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == want[i] for i in held) / len(held) > 0.97


def test_held_out_rows_and_labels_teach_nothing(labelled):
    import pyspark.sql.functions as F

    swapped = labelled.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(labelled).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language.identify(swapped).collect()}


def test_odd_documents(odd, labelled, none):
    model = language.fit(labelled)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by_id[i].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4 and by_id[3].score == 0
    assert by_id[1].lang_pred == "en" and not by_id[1].ambiguous
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none)).collect()} == {"und"}
    one = language.identify(labelled, language.fit(labelled.where("lang = 'en'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 6, 7} and not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}


def test_words_alone_and_together_have_the_same_grams():
    words = ["a", "éa", "haus", "x" * 70, "日本"]
    h, starts = language.grams(words)
    together = np.split(h, starts[1:])
    for w, got in zip(words, together, strict=True):
        assert sorted(got) == sorted(language.grams([w])[0])


def test_codewords():
    for n in (2, 3, 4, 6, 7, 20):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert all(abs(b.sum()) < n for b in code.T)


def test_decoding_prefers_the_nearest_codeword():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((1, 7), np.float32), np.ones(7))
    noisy = code.copy() * 5
    noisy[:, 0] *= -1
    best, score = model.decode(noisy)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.9).all()
    assert model.decode(np.zeros((1, 7)))[1][0] == pytest.approx(0.25)
