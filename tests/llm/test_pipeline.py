import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from scenelake.llm import language, pieces
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def test_stage_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "merge_dropout_pieces"
    ]
    for kept in steps[:-1]:
        assert kept.columns == steps[0].columns
    assert steps[-1].columns == ["doc_id", "n_pieces", "ids"]


def test_language_stage_keeps_clean_documents(steps):
    seen = {r.doc_id for r in language.identify(steps[0]).collect() if r.lang_pred != "und" and not r.ambiguous}
    assert Counter(r.doc_id for r in steps[1].collect()) == Counter(r.doc_id for r in steps[0].collect() if r.doc_id in seen)
    assert len(seen) > 0.95 * steps[0].select("doc_id").distinct().count()


def test_exact_stage(steps):
    best = {}
    for r in steps[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(i for _, i in best.values())


def test_near_stage(steps):
    told = [(r.doc_id, brute_fingerprint(r.text)) for r in steps[2].collect()]
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(set(brute_components(told).values()))


def test_mix_stage(steps):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in steps[3].collect():
        sizes[r.source] += size(r.text)
    rows = steps[4].collect()
    for r in rows:
        taken[r.source] += size(r.text)
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    longest = max(size(r.text) for r in rows)
    want = brute_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= max(2, longest / 10) for s in want)


def test_token_stage(steps):
    model = pieces.load()
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    assert all(pieces.decode(model, r.ids) == texts[r.doc_id] and r.n_pieces == len(r.ids) for r in rows)


def test_run(spark, steps):
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in steps[-1].collect())


def test_odd_documents_pass_all_stages(spark, odd, none):
    for docs in (odd.withColumn("n_chars", odd["size"]), none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            docs = stage(spark, docs, SF)
            assert i == 4 or docs.columns == before
        docs.collect()
