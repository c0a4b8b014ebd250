import hashlib
import re

from scenelake.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def test_odd_documents(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows)
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)


def test_summary_finds_every_frequent_digest(spark):
    rows = [(i, f"t{i}" if i % 3 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_groups(df, counters=8)
    assert got.where("group_size = 1000 and keep_id = 0").count() == 1000
    assert got.where("kept").count() == 2001


def test_kept_documents_have_all_columns(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len(brute([(r.doc_id, r.text) for r in odd.collect()]))
    assert {r["_row"] for r in rows} == {7} and {r["_doc"] for r in rows} == {"x"}


def test_empty(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0


def test_no_python(odd):
    plan = exact_dedup.exact_groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
