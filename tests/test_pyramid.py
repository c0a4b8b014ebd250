import math
import random

import pytest
from pyspark.sql import functions as F

from scenelake.operators import pyramid as P
from tests.test_clouds import BOX, POINT, counts, inside


def descended(spark, points, boxes):
    blocks = P.blocks_of(points, "lidar_uid")
    levels = P.levels_above(blocks, "lidar_uid")
    added, border = P.descend(blocks, levels, spark.createDataFrame(boxes, BOX), "lidar_uid")
    return blocks, levels, added, border


def square(spark, n):
    """n points spread evenly over 100 by 100 metres."""
    return spark.range(n).select(
        F.lit(1).alias("lidar_uid"),
        *[(F.rand(seed) * 100).alias(a) for seed, a in ((1, "x"), (2, "y"))],
        F.lit(0.5).alias("z"),
    )


def test_pairs_grow_with_the_border(spark):
    """Sixteen times the points in a box that holds half of them: about four times the blocks to test."""
    box = [(1, 0, 50.0, 50.0, 0.5, 70.0, 70.0, 2.0, 0.3)]
    tested, blocks = [], []
    for n in (20_000, 320_000):
        all_blocks, levels, _, border = descended(spark, square(spark, n), box)
        tested.append(border.count())
        blocks.append(all_blocks.count())
    assert len(levels) >= 2 and blocks[1] > 14 * blocks[0]
    assert tested[1] < 8 * tested[0] and tested[1] < blocks[1] / 5
    points = square(spark, 20_000)
    got = P.points_in_boxes(points, spark.createDataFrame(box, BOX)).first()["points_in_box"]
    assert got == sum(inside(tuple(r), box[0]) for r in points.collect())


@pytest.fixture
def uncoalesced(spark):
    """Small partitions are kept apart, as large ones would be."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_one_spot(spark, uncoalesced):
    """However many points share a spot, several tasks hold them and none is tested alone."""
    points = spark.range(30_000).select(F.lit(1).alias("lidar_uid"), *[F.lit(v).alias(a) for a, v in zip("xyz", (3.0, 4.0, 0.0))])
    boxes = [(1, 0, 3.0, 4.0, 0.0, 1.0, 1.0, 1.0, 0.7), (1, 1, 9.0, 9.0, 0.0, 1.0, 1.0, 1.0, 0.0), (1, 2, 4.0, 4.0, 0.0, 2.0, 1.0, 1.0, 0.0)]
    blocks, _, _, border = descended(spark, points, boxes)
    assert blocks.agg(F.max("_n")).first()[0] <= P.BLOCK
    assert blocks.select(F.shiftright("_node", 27)).distinct().count() > 1
    assert border.count() == 0
    got = P.points_in_boxes(points, spark.createDataFrame(boxes, BOX))
    assert {r.box_idx: r.points_in_box for r in got.collect()} == {0: 30_000, 2: 30_000}


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5])
def test_any_scale(spark, scale):
    draw = random.Random(8)
    points = [(draw.choice([1, 1, 1, 2]), *(draw.gauss(0, scale) for _ in range(3))) for _ in range(3000)]
    boxes = [
        (draw.choice([1, 2]), i, draw.gauss(0, scale), draw.gauss(0, scale), 0.0, *(scale * 10 ** draw.uniform(-1, 1) for _ in range(3)), draw.uniform(-4, 4))
        for i in range(30)
    ]
    want = {}
    for b in boxes:
        n = sum(p[0] == b[0] and inside(p, b) for p in points)
        if n:
            want[(b[0], b[1])] = n
    assert counts(spark, points, boxes) == want and len(want) > 8


def test_odd_values(spark):
    nan, inf = math.nan, math.inf
    points = [(1, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), (1, nan, 0.0, 0.0), (1, inf, 0.0, 0.0), (1, 0.1, -inf, 0.0), (1, 0.2, 0.1, nan), (None, 0.0, 0.0, 0.0)]
    boxes = [(1, 0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.4), (1, 1, None, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0), (1, 2, 0.0, 0.0, 0.0, -2.0, 2.0, 2.0, 0.0), (1, 3, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, nan)]
    assert counts(spark, points, boxes) == {(1, 0): 1}


def test_no_python_and_no_cross_join(spark):
    points, boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], POINT), spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0)], BOX)
    plan = P.points_in_boxes(points, boxes)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
