import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import clouds as C
from scenelake.operators.pyramid import points_in_boxes

BOX = "lidar_uid INT, box_idx INT, x DOUBLE, y DOUBLE, z DOUBLE, length DOUBLE, width DOUBLE, height DOUBLE, yaw DOUBLE"
POINT = "lidar_uid INT, x DOUBLE, y DOUBLE, z DOUBLE"


def inside(p, b):
    dx, dy, dz = p[1] - b[2], p[2] - b[3], p[3] - b[4]
    c, s = math.cos(b[8]), math.sin(b[8])
    return abs(c * dx + s * dy) <= b[5] / 2 and abs(c * dy - s * dx) <= b[6] / 2 and abs(dz) <= b[7] / 2


def counts(spark, points, boxes):
    out = points_in_boxes(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX))
    return {(r.lidar_uid, r.box_idx): r.points_in_box for r in out.collect()}


def test_random_boxes_of_all_sizes(spark):
    rng = random.Random(4)
    points = [(rng.choice([1, 1, 1, 2]), *(rng.uniform(-40, 40) for _ in range(2)), rng.uniform(-2, 2)) for _ in range(1500)]
    size = lambda: 10 ** rng.uniform(-1.5, 2.2)
    boxes = [
        (rng.choice([1, 2]), i, rng.uniform(-40, 40), rng.uniform(-40, 40), 0.0, size(), size(), rng.uniform(0.5, 4), rng.uniform(-7, 7))
        for i in range(60)
    ]
    want = {}
    for b in boxes:
        n = sum(p[0] == b[0] and inside(p, b) for p in points)
        if n:
            want[(b[0], b[1])] = n
    assert counts(spark, points, boxes) == want and len(want) > 20


def test_faces_belong_to_the_box(spark):
    box = (1, 0, 0.0, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0)
    on = [(1, 2.0, 0.0, 0.0), (1, -2.0, 1.0, -1.0), (1, 0.0, -1.0, 1.0)]
    off = [(1, 2.0000001, 0.0, 0.0), (1, 0.0, 0.0, 1.0000001), (2, 0.0, 0.0, 0.0)]
    assert counts(spark, on + off, [box]) == {(1, 0): 3}


def test_no_boxes_and_empty_boxes(spark):
    assert counts(spark, [(1, 0.0, 0.0, 0.0)], []) == {}
    assert counts(spark, [(1, 9.0, 9.0, 9.0)], [(1, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0)]) == {}


def test_origin_box_pairs_x_with_width(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (0, 2.0, 1.0, 3.0)], POINT)
    assert C.points_in_origin_box(df, width=2.0, length=4.0, height=6.0).first()["n_points"] == 1


def test_valid_returns(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0, -1.0, 2.0], [5, 6, 7, 8]), (2, [1.0], None)], "i INT, r ARRAY<DOUBLE>, l ARRAY<INT>"
    )
    got = df.select(C.valid_returns(F.col("r"), F.col("l")).alias("v")).collect()
    assert [r.v for r in got] == [[5, 8], []]


def test_usable_sweeps(spark):
    df = spark.createDataFrame(
        [(1, [0, 0], None), (2, [0, 3], None), (3, None, []), (4, None, None), (5, [0], ["b"])],
        "i INT, lidar_segmentation ARRAY<INT>, lidar_box ARRAY<STRING>",
    )
    assert sorted(r.i for r in C.usable_sweeps(df).collect()) == [2, 3, 5]


def farthest(points, n):
    picked = [0]
    while len(picked) < n:
        best = [min(sum((a - b) ** 2 for a, b in zip(p, points[k])) for k in picked) for p in points]
        picked.append(best.index(max(best)))
    return sorted(picked)


def cloud(spark, sizes):
    rng = np.random.default_rng(2)
    rows = [(i, [tuple(map(float, p)) for p in rng.normal(size=(n, 3)).astype(np.float32)], list(range(n))) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "lidar_uid INT, points ARRAY<STRUCT<x: FLOAT, y: FLOAT, z: FLOAT>>, labels ARRAY<INT>"), rows


def test_farthest_points_against_brute_force(spark):
    df, rows = cloud(spark, [30, 5, 80, 0, 12])
    got = {r.lidar_uid: r.picked for r in C.farthest_points(df, 12, keep=["lidar_uid"]).collect()}
    for uid, points, _ in rows:
        assert got[uid] == (farthest(points, 12) if len(points) > 12 else list(range(len(points))))


def test_downsample_keeps_labels_aligned(spark):
    df, rows = cloud(spark, [30, 5])
    out = C.downsample(df, 8, ["labels"]).collect()
    assert [len(r.points_downsampled) for r in out] == [8, 5]
    for r in out:
        for p, i in zip(r.points_downsampled, r.labels_downsampled):
            assert tuple(p) == tuple(r.points[i])


def test_flip_is_one_of_four_and_seeded(spark):
    df, rows = cloud(spark, [3] * 40)
    def run(seed):
        out = df.select("lidar_uid", "points", C.flip(F.col("points"), F.col("lidar_uid"), seed).alias("f")).collect()
        signs = {}
        for r in out:
            pair = {(round(f.x / p.x), round(f.y / p.y)) for p, f in zip(r.points, r.f)}
            assert len(pair) == 1 and all(p.z == f.z for p, f in zip(r.points, r.f))
            signs[r.lidar_uid] = pair.pop()
        return signs

    first = run(1)
    assert first == run(1) != run(2)
    assert set(first.values()) == {(1, 1), (-1, 1), (1, -1), (-1, -1)}


def test_probabilities(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [3.0, 0.0]],)], "p ARRAY<ARRAY<FLOAT>>")
    assert df.select(C.normalize_classes(F.col("p")).alias("n")).first()["n"] == [[0.25, None], [0.75, None]]
    q = spark.createDataFrame([([0.0, 0.5, 0.999, 1.0],)], "p ARRAY<DOUBLE>")
    assert q.select(C.quantize(F.col("p")).alias("q")).first()["q"] == [0, 127, 254, 255]


def test_slices(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]],)], "r ARRAY<ARRAY<DOUBLE>>")
    s = df.select(C.split_features(F.col("r")).alias("s")).first()["s"]
    assert s.features == [[1.0, 2.0, 3.0]] and tuple(s.points[0]) == (4.0, 5.0, 6.0)
    s = df.select(C.split_intensity(F.col("r")).alias("s")).first()["s"]
    assert s.features == [[4.0]] and tuple(s.points[0]) == (1.0, 2.0, 3.0)


@pytest.mark.parametrize("sensor", ["front", "top"])
def test_concat_keeps_every_sensor(spark, sensor):
    df = spark.createDataFrame(
        [(1, "top", [(1.0, 1.0, 1.0)]), (1, "front", [(2.0, 2.0, 2.0), (3.0, 3.0, 3.0)])],
        "frame INT, lidar_id STRING, points ARRAY<STRUCT<x: FLOAT, y: FLOAT, z: FLOAT>>",
    )
    rows = C.concat_sensors(df, ["frame"], "lidar_id").where(F.col("lidar_id") == sensor)
    assert rows.count() == {"top": 1, "front": 2}[sensor]
