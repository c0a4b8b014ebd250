import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scenelake.plans.selection import Selection


def data(n=3000):
    draw = random.Random(1)
    start = datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        time = None if i % 17 == 0 else start + timedelta(microseconds=draw.randrange(10**9) if i % 3 else 5)
        rows.append((time, draw.choice([None, 'a "q"', "é\n", "", "Z"]), draw.choice([0.1, -2.5, float("inf"), None, 1e-300]), i))
    return rows


SCHEMA = "t timestamp_ntz, s string, d double, i long"


def ordered(rows):
    """Ascending, nulls last, in text byte order."""
    value = lambda x: (1, 0) if x is None else (0, x.encode() if isinstance(x, str) else x)
    return sorted(rows, key=lambda r: [value(x) for x in r])


@pytest.mark.parametrize("offset,limit", [(0, 1), (0, 200), (7, 5), (990, 1200), (2500, 0), (2990, 100), (3000, 5), (9999, 0)])
def test_pages(spark, offset, limit):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = ordered(rows)[offset : offset + limit if limit else None]
    for sizes in ({}, {"edge_rows": 40, "ranges": 6, "drawn": 30}):
        got = Selection(df, ["t", "s", "d", "i"], **sizes).page(offset, limit)
        assert ordered(map(tuple, got.collect())) == want
    leading = df.select("t")
    got = Selection(df, ["t", "s", "d", "i"], edge_rows=40, ranges=6, drawn=30).page(offset, limit, leading)
    assert ordered(map(tuple, got.collect())) == want


@pytest.mark.parametrize("offset,limit", [(0, 10), (5, 10), (100, 450), (590, 20), (150, 0), (0, 600)])
def test_ties(spark, offset, limit):
    """Rows alike in the whole key: a page takes as many as it needs."""
    rows = [(x,) for x in [1] * 200 + [2] * 300 + [None] * 100]
    df = spark.createDataFrame(rows, "x int").repartition(3)
    want = [r[0] for r in rows][offset : offset + limit if limit else None]
    for edge in (1 << 16, 50):
        got = [r.x for r in Selection(df, ["x"], edge_rows=edge, ranges=4, drawn=40).page(offset, limit).collect()]
        assert sorted(got, key=lambda x: (x is None, x)) == want


def test_empty(spark):
    df = spark.createDataFrame([], "x int")
    assert Selection(df, ["x"]).page(0, 5).count() == Selection(df, ["x"]).page(3).count() == 0


def test_page_is_a_filter_at_the_scan(spark, tmp_path):
    """A page of 200 reads only the row groups between its keys, and neither shuffles nor writes the rest."""
    path = str(tmp_path / "t")
    spark.range(100_000).select((F.col("id") * 7).alias("t"), "id").repartitionByRange(20, "t").sortWithinPartitions(
        "t"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    exact = Selection(df, ["t", "id"], edge_rows=100).page(50_000, 200)
    plan = exact._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(t,350000)" in plan and "LessThanOrEqual(t,351400)" in plan
    assert "Exchange" not in plan and "Scan ExistingRDD" not in plan
    assert exact.select(F.input_file_name()).distinct().count() == 1
    touched = Selection(df, ["t", "id"]).page(50_000, 200)
    plan = touched._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(t," in plan and "LessThanOrEqual(t," in plan and "Scan ExistingRDD" not in plan
    for page in (exact, touched):
        assert sorted(r.id for r in page.collect()) == list(range(50_000, 50_200))
