import math

import numpy as np
import pytest
import pyspark.sql.functions as F

from scenelake.llm import topk


def brute(rows, wanted, k):
    usable = [
        (i, [math.floor(1024 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in sorted({(i, tuple(q)) for i, q in usable if wanted(i)}):
        scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in usable if j != i and len(p) == len(q)]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return out


def run(spark, rows, wanted, condition, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm double").repartition(3)
    got = topk.top_k(df, condition, **sizes).collect()
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    assert sorted(map(tuple, got)) == sorted(brute(plain, wanted, sizes.get("k", 10)))


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_against_brute_force(spark, spread):
    draw = np.random.default_rng(6)
    rows = []
    for i in range(700):
        v = draw.normal(size=8) * math.exp(spread * draw.normal())
        rows.append((i, (np.round(v, 1) if i % 3 else np.round(v)).tolist(), 1.0))
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], 1.0) for i in range(40)]
    run(spark, rows, lambda i: i % 20 == 0, F.col("vec_id") % 20 == 0, bucket=64, block=8)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1.0), (1, None, 1.0), (2, [], 1.0), (3, [1.0, None], 1.0), (4, [nan, 1.0], 1.0), (5, [inf, 0.0], 1.0),
            (None, [1.0, 1.0], 1.0), (6, [1.0], 1.0), (7, [0.0, 0.0], 1.0), (8, [-1.0, -2.0], 1.0), (8, [1.0, 0.0], 1.0),
            (9, [1e6, 2e6], None), (10, [0.0, 0.0], 1.0)]
    run(spark, rows, lambda i: i % 2 == 0, F.col("vec_id") % 2 == 0, k=3, bucket=4, block=2)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 2 == 0).count() == 0


def test_pruning_keeps_every_candidate():
    draw = np.random.default_rng(7)
    for _ in range(60):
        p = draw.integers(-900, 900, (300, 6)) * draw.integers(1, 5, (300, 1))
        norms = np.sqrt((p * p).sum(axis=1))
        order = np.argsort(-norms)
        p, norms = p[order], norms[order]
        q = draw.integers(-900, 900, 6)
        s = p @ q
        theta = float(np.sort(s)[-draw.integers(1, 30)])
        keep = topk.candidates(q, float(np.sqrt(q @ q)), theta, p, norms)
        assert set(np.flatnonzero(s >= theta)) <= set(keep.tolist())


def test_settings_come_back_and_long_vectors_are_told(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = [(0, [2.0e6, 1.0]), (1, [-2.0e6, 2.0e6]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") >= 0, k=2, bucket=2, block=1).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, lambda i: True, 2)) and spark.conf.get(key) == before
    huge = spark.createDataFrame([*rows, (3, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="vector 3 is too long"):
        topk.top_k(huge, F.col("vec_id") >= 0).collect()
    assert spark.conf.get(key) == before


def test_needed_buckets_are_those_long_enough(spark):
    draw = np.random.default_rng(8)
    buckets, blocks, want = [], [], set()
    number = 0
    for dim in (2, 5, 9):
        lengths = sorted(np.round(draw.uniform(0, 4, 30), 1).tolist(), reverse=True)
        buckets += [(dim, number + i, [x, 0.0]) for i, x in enumerate(lengths)]
        for block in range(20):
            norms, theta = np.round(draw.uniform(0, 2, 3), 1).tolist(), np.round(draw.uniform(-1, 9, 3), 1).tolist()
            theta = [t if n else min(t, 0.0) for n, t in zip(norms, theta)]
            blocks.append((dim, block, norms, theta))
            for i, x in enumerate(lengths):
                if any(t <= 0 or n * x >= t * (1 - 1e-9) for n, t in zip(norms, theta)):
                    want.add((dim, block, number + i))
        number += len(lengths) - 1
    got = topk._needed(
        spark.createDataFrame(blocks, "dim int, block long, block_norms array<double>, theta array<double>"),
        spark.createDataFrame(buckets, "dim int, bucket long, bucket_norms array<double>"),
    )
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 300
