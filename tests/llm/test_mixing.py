import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scenelake.llm import mixing


def brute_targets(sizes):
    """Water filling by weights 5, 2, 1 in order of the sources, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        rate = (total - sum(capped.values())) / max(sum(weight[s] for s in rest), 1)
        over = [s for s in rest if rate * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: rate * weight[s] for s in rest}
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(df, spark):
    docs = df.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += size(d.text)
    want = brute_targets(sizes) if docs else {}
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d.doc_id, size(d.text), d.source) for d in docs)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in got) == Counter((r.doc_id, r.source, r.taken) for r in again)
    return want, taken


def test_targets_are_met(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 7}") for i in range(400)] + [(1000 + i, "w " * 5, "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want, taken = check(df, spark)
    # All documents of the hot source have five words; no sum of them is nearer.
    assert all(abs(taken[s] - want[s]) <= (5 if s == "hot" else 1) for s in want)


def test_odd_documents(spark, odd, none):
    check(odd, spark)
    assert mixing.mix(none).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0.0, 0), (0.0, 0)]


def test_mixed_documents(spark, odd):
    mixed = mixing.apply_mix(odd)
    assert mixed.columns == odd.columns
    want = Counter()
    for r in mixing.mix(odd.where("doc_id > 1")).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = Counter((r.doc_id, r.source) for r in mixing.apply_mix(odd.where("doc_id > 1")).collect())
    assert got == +want


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.data())
def test_fit_is_close(counts, data):
    lengths = np.array(list(counts), np.int64)
    numbers = np.array(list(counts.values()), np.int64)
    total = int((lengths * numbers).sum())
    budget = data.draw(st.integers(0, total))
    chosen = mixing.fit(lengths, numbers, budget)
    assert (chosen >= 0).all() and (chosen <= numbers).all()
    assert 0 <= budget - int((lengths * chosen).sum()) <= int(lengths.max())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=7), st.integers(0, 200))
def test_knapsack_is_best(counts, budget):
    lengths, numbers = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1)}
    chosen = mixing.knapsack(lengths, numbers, budget)
    assert (chosen <= numbers).all()
    assert int((lengths * chosen).sum()) == max(r for r in reach if r <= budget)


def test_long_documents_are_fitted_from_above():
    one = lambda lengths, counts, budget: mixing.nearest(np.array(lengths), np.array(counts), budget).tolist()
    assert one([1000], [2], 999) == [1]
    assert one([1_000_000, 10], [1, 10], 900_000) == [1, 0]
    assert one([1_000_000, 10], [1, 10], 400_000) == [0, 10]
    assert one([10], [3], 15) == [1] and one([10], [3], 0) == [0] and one([10], [3], 30) == [3]
    # Too many words for one program over all of them.
    assert one([900_000_000, 10], [1, 10], 800_000_000) == [1, 0]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.data())
def test_nearest_is_best(counts, data):
    lengths, numbers = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1)}
    budget = data.draw(st.integers(0, max(reach)))
    chosen = mixing.nearest(lengths, numbers, budget)
    assert (chosen >= 0).all() and (chosen <= numbers).all()
    assert abs(int((lengths * chosen).sum()) - budget) == min(abs(r - budget) for r in reach)


def test_source_of_one_long_document(spark):
    # Weights 5, 2 and 1: the targets are 3000, 7605 and 3803 words.
    rows = [(1, "w " * 1000, "a"), (2, "w " * 10_000, "b"), *[(10 + i, "w " * 10, "b") for i in range(10)],
            (30, "w " * 3300, "c"), (31, "w " * 8, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, taken = check(df, spark)
    assert {s: round(w) for s, w in want.items()} == {"a": 3000, "b": 7605, "c": 3803}
    assert taken == {"a": 3000, "b": 10_000, "c": 3316}


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_other_caps(spark, cap):
    # Weights 5 and 2: the small source wants far more than its five times.
    rows = [(i, "w " * (3 + i % 4), "a") for i in range(10)] + [(100 + i, "w " * (1 + i % 9), "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = defaultdict(int)
    got = mixing.mix(df, cap=cap).collect()
    for r in got:
        assert 0 <= r.copies <= cap
        taken[r.source] += r.taken
    want = {r.source: r.target for r in got}
    assert want["a"] == cap * sum(3 + i % 4 for i in range(10))
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_repeated_rows_take_all_their_words(spark):
    # Of rows without doc_id, and of repeated ones, the fit takes some but not all.
    rows = [(None, f"w{i} " * 5, "a", i) for i in range(60)] + [(7, f"v{i} " * 4, "b", i) for i in range(70)]
    rows += [(100 + i, "w " * (2 + i % 9), "c", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at int").repartition(4)
    want, plan = Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
        plan[(r.doc_id, r.source, r.size)] += r.copies
    assert plan[(None, "a", 5)] % 60 and plan[(7, "b", 4)] % 70
    got, copies, taken = mixing.apply_mix(df).collect(), Counter(), Counter()
    for r in got:
        copies[(r.source, r.at)] += 1
        taken[r.source] += len(r.text.split())
    assert taken == want and max(copies.values()) <= mixing.CAP
    by_text = [copies[("a", i)] for i in range(60)]
    assert max(by_text) - min(by_text) == 1
    again = Counter((r.source, r.at) for r in mixing.apply_mix(df.repartition(3)).collect())
    assert {k: n for k, n in again.items() if k[0] != "c"} == {k: n for k, n in copies.items() if k[0] != "c"}
