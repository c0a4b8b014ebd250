import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scenelake.llm import splitters


def brute(rows, shards):
    """(doc_id, text) to [(shard, slot), ...], from one sorted list."""
    keyed = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if d is None else d, d, t) for d, t in rows)
    sizes = Counter()
    for h, k, _, t in keyed:
        sizes[h, k] += len((t or "").encode()) + 16
    total, before, shard_of = sum(sizes.values()), 0, {}
    for key in sorted(sizes):
        shard_of[key] = (2 * before + sizes[key]) * shards // (2 * total)
        before += sizes[key]
    slots, out = Counter(), defaultdict(list)
    for h, k, d, t in keyed:
        s = shard_of[h, k]
        out[d, t or ""].append((s, slots[s]))
        slots[s] += 1
    return out


def placed(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id, r.text or ""].append((r.shard, r.slot))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("shards,ranges", [(1, 1), (3, 4), (40, 32), (7, 300)])
def test_brute_force(spark, shards, ranges):
    """A third of the rows hold one text, one text is very long, some rows are repeated."""
    rows = [(i, "copy " * 5 if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(900)]
    rows += [(5000, "long " * 20_000), (7, None), (8, ""), (None, "x"), (None, "x"), (17, rows[17][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert placed(splitters.shard(docs, shards, ranges)) == brute(rows, shards)


def test_equal_sizes(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"a text of some length {i}" * (1 + i % 7)) for i in range(4000)]
    got = splitters.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    sizes = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    longest = max(len(t.encode()) + 16 for _, t in rows)
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * longest
    # Copies lie in a run of neighbouring shards.
    held = sorted(r["shard"] for r in got.where("text = 'copy'").select("shard").distinct().collect())
    assert held == list(range(held[0], held[-1] + 1))


def test_ranges_are_bounded(spark):
    """However hot a text is, its rows are dealt over many ranges."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one text for all").alias("text"))
    bounds, ranges = splitters.splitters(docs, 10, 16)
    rows = [r.rows for r in ranges]
    assert sum(rows) == 20_000 and len(bounds) >= 100 and max(rows) <= 2 * 20_000 / 160 + 1


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}" * (i % 9)) for i in range(300)], "doc_id long, text string")
    splitters.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert placed(back) == placed(splitters.shard(docs, 5))


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = splitters.shard(odd, 4)
    assert placed(got) == brute(rows, 4)
    assert set(odd.columns) <= set(got.columns) and {r.h for r in got.collect()} == {1}
    assert splitters.placements(splitters.shard(none, 4)).count() == 0


def test_no_python(odd):
    plan = splitters.placements(splitters.shard(odd, 4))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
