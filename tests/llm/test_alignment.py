import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from scenelake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(A), alignment.PieceModel(B)


def brute(sides, texts):
    """Groups and links token by token; corpus counts over all of ``texts``."""
    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        ids = [s.encode([text])[0] for s in sides]
        raw = (" " + text).encode()
        if any(b"".join(s.spelled[i] for i in x) != raw for s, x in zip(sides, ids, strict=True)):
            rows.append(None)
            continue
        spans = []
        for s, x in zip(sides, ids, strict=True):
            at, own = 0, []
            for i in x:
                own.append((at, at + len(s.spelled[i])))
                at = own[-1][1]
            spans.append(own)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, was = [], 0
        for end in both:
            sides_of = [[str(i) for i, (s, e) in zip(x, own, strict=True) if s >= was and e <= end] for x, own in zip(ids, spans, strict=True)]
            groups.append("|".join(",".join(g) for g in sides_of))
            was = end
        links = [
            (a, b)
            for a, (s, e) in zip(ids[0], spans[0], strict=True)
            for b, (u, v) in zip(ids[1], spans[1], strict=True)
            if s < v and u < e
        ]
        counts.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, sha = row
            best = sum(counts[x] == highest[x[1]] for x in links)
            out.append((n_a, n_b, n_groups, len(links), best, sum(counts[x] for x in links), sha))
    return out


def texts():
    draw = random.Random(5)
    parts = ["the ", "river", " ", "  ", "\n", "Größe", "日本", "🙂", "▁", "<|endoftext|>", "</s>", "\x00", "ﬁ", "1234", "'s", " ", "x" * 9]
    return [None, "", " ", *["".join(draw.choices(parts, k=draw.randrange(1, 25))) for _ in range(120)]]


def result(df):
    columns = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return [tuple(r[c] for c in columns) for r in df.orderBy("doc_id").collect()]


def test_brute_force(spark, sides):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(sides, [t for _, t in rows])
    assert sum(bool(w[0]) for w in want) > 40 and any(not w[0] for w in want[3:])
    assert result(alignment.alignments(docs)) == want


def test_few_frequent_pairs(spark, sides, tmp_path):
    """What the broadcast pairs do not cover comes from the join."""
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    alignment.align(docs).withColumn("_row", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "a"))
    aligned = spark.read.parquet(str(tmp_path / "a"))
    counts = alignment.pair_counts(aligned, sides[1].size)
    want = brute(sides, [t for _, t in rows])
    for frequent in (0, 3, 10**6):
        assert result(alignment.with_counts(aligned, counts, frequent)) == want


@pytest.mark.parametrize("seed", range(20))
def test_gallop(seed):
    draw = np.random.default_rng(seed)
    shorter = np.unique(draw.integers(0, 5000, draw.integers(1, 700)))
    longer = np.unique(draw.integers(0, 5000, draw.integers(1, 3000)))
    assert (alignment.gallop(shorter, longer) == np.searchsorted(longer, shorter)).all()


def test_gallop_far_apart():
    longer = np.arange(1_000_000)
    assert (alignment.gallop(np.array([0, 999_999]), longer) == [0, 999_999]).all()
    assert (alignment.gallop(np.array([2_000_000]), longer) == [1_000_000]).all()


def test_odd_rows(odd, none, sides):
    rows = odd.collect()
    short = [r.text if r.text and len(r.text) < 1000 else None for r in rows]
    got = alignment.alignments(odd).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[6].n_a and by_id[6].n_groups  # the very long text
    assert by_id[3].groups_sha256 == by_id[4].groups_sha256 == "" and by_id[4].n_links == 0
    digests = [w[-1] for w in brute(sides, short)]
    assert sorted(d for d in digests if d) == sorted(r.groups_sha256 for r in got if r.groups_sha256 and r.doc_id != 6)
    assert alignment.alignments(none).count() == 0
