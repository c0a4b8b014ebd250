import random

from pyspark.sql import functions as F

from scenelake.plans.ordered import ordered_index, ranked, running_both_ways


def rows(n=500, seed=1):
    rng = random.Random(seed)
    # One group holds most rows, one key is NULL.
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(40), i, rng.randrange(100)) for i in range(n)]


SCHEMA = "g STRING, t INT, i INT, v INT"


def test_index_is_dense_and_ordered(spark):
    data = rows()
    df, total = ordered_index(spark.createDataFrame(data, SCHEMA), [F.col("t"), F.col("i")], slices=7)
    got = sorted((r.row_idx, r.i) for r in df.collect())
    assert total == len(data)
    assert [i for _, i in got] == [r[2] for r in sorted(data, key=lambda r: (r[1], r[2]))]
    assert [k for k, _ in got] == list(range(len(data)))


def test_index_of_nothing(spark):
    df, total = ordered_index(spark.createDataFrame([], SCHEMA), [F.col("t")])
    assert total == 0 and df.count() == 0


def test_rank_in_groups_that_span_slices(spark):
    data = rows()
    df = ranked(spark.createDataFrame(data, SCHEMA), ["g"], [F.col("t"), F.col("i")], slices=7)
    want = {}
    for g in {r[0] for r in data}:
        for k, r in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = k
    assert {r.i: r.rn for r in df.collect()} == want


def test_running_maximum_both_ways(spark):
    data = rows(300, 3)
    df = running_both_ways(
        spark.createDataFrame(data, SCHEMA), ["g"], [F.col("t"), F.col("i")], "v", F.max, F.greatest, slices=6
    )
    got = {r.i: (r._up_to, r._from_on) for r in df.collect()}
    for g, t, i, _ in data:
        group = [r for r in data if r[0] == g]
        assert got[i] == (
            max(r[3] for r in group if (r[1], r[2]) <= (t, i)),
            max(r[3] for r in group if (r[1], r[2]) >= (t, i)),
        )
