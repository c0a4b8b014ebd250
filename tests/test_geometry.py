import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions import pose as P
from scenelake.operators import geometry as G


def matrix(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array(
        [
            [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)],
            [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
            [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
        ]
    )


RNG = np.random.default_rng(3)
QUATERNIONS = [q.tolist() for q in RNG.normal(size=(12, 4))] + [
    [1.0, 0.0, 0.0, 0.0],
    [0.0, 1.0, 0.0, 0.0],
    [0.0, 0.0, 1.0, 0.0],
    [0.0, 0.0, 0.0, 1.0],
]


@pytest.fixture(scope="module")
def poses(spark):
    rows = [(i, q, RNG.normal(size=3).tolist()) for i, q in enumerate(QUATERNIONS)]
    return spark.createDataFrame(rows, "i INT, q ARRAY<DOUBLE>, t ARRAY<DOUBLE>")


def test_rotation_matrix_and_back(poses):
    rows = poses.withColumn("m", P.rotation_matrix(F.col("q"))).withColumn("back", P.quaternion_of(F.col("m"))).collect()
    for r in rows:
        assert np.allclose(np.reshape(r.m, (3, 3)), matrix(r.q))
        unit = np.array(r.q) / np.linalg.norm(r.q)
        assert np.allclose(r.back, unit) or np.allclose(r.back, -unit)


def test_inverse_undoes_the_pose(poses):
    both = poses.select(
        P.pose_matrix(F.col("q"), F.col("t")).alias("a"), P.pose_matrix(F.col("q"), F.col("t"), inverse=True).alias("b")
    )
    for r in both.select(P.matrix_product(F.col("a"), F.col("b")).alias("m"), "a").collect():
        assert np.allclose(np.reshape(r.m, (4, 4)), np.eye(4), atol=1e-12)
        assert r.a[12:] == [0.0, 0.0, 0.0, 1.0]
    decomposed = both.select("a", P.quaternion_of(F.col("a"), 4).alias("q"), P.translation_of(F.col("a")).alias("t"))
    for r in decomposed.collect():
        assert np.allclose(matrix(r.q), np.reshape(r.a, (4, 4))[:3, :3])
        assert np.allclose(r.t, np.reshape(r.a, (4, 4))[:3, 3])


def test_point_motions(spark):
    q, t, p = [0.3, -0.2, 0.9, 0.1], [1.0, 2.0, 3.0], np.array([0.5, -1.5, 2.5])
    df = spark.createDataFrame([(q, t, *p.tolist())], "q ARRAY<DOUBLE>, t ARRAY<DOUBLE>, x DOUBLE, y DOUBLE, z DOUBLE")
    df = df.withColumn("r", P.rotation_matrix(F.col("q"))).withColumn("m", P.pose_matrix(F.col("q"), F.col("t")))
    xyz = lambda d: np.array([d.first()[a] for a in "xyz"])
    r = matrix(q)
    assert np.allclose(xyz(G.rotate_points(df, F.col("r"))), p @ r)
    assert np.allclose(xyz(G.translate_points(df, F.col("t"))), p + t)
    assert np.allclose(xyz(G.transform_points(df, F.col("m"))), r @ p + t)
    assert np.allclose(xyz(G.points_to_ego(df, F.col("q"), F.col("t"))), r @ p + t)
    assert np.allclose(xyz(G.points_to_ego(df, F.col("q"), F.col("t"), "as_coded")), p @ r - t)
    with pytest.raises(ValueError):
        G.points_to_ego(df, F.col("q"), F.col("t"), "other")


def test_quaternion_product(spark):
    a, b = QUATERNIONS[0], QUATERNIONS[1]
    df = spark.createDataFrame([(a, b)], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    ab = df.select(P.quaternion_product(F.col("a"), F.col("b")).alias("p")).first()["p"]
    assert np.allclose(matrix(ab), matrix(a) @ matrix(b))


def shots(spark, points, width=100, height=80, focal=10.0):
    df = spark.createDataFrame(points, "x DOUBLE, y DOUBLE, z DOUBLE")
    k = P.projection_matrix(F.array(*[F.array(*[F.lit(v) for v in r]) for r in [(focal, 0.0, 50.0), (0.0, focal, 40.0), (0.0, 0.0, 1.0)]]))
    here = (F.col("x"), F.col("y"), F.col("z"))
    return df, k, here, F.lit(width), F.lit(height)


def test_visibility_bounds_are_strict(spark):
    edge = lambda u, v, z=2.0: ((u - 50) * z / 10, (v - 40) * z / 10, z)
    points = [edge(50, 40), edge(50, 40, 1.0), edge(1, 40), edge(1.5, 40), edge(99, 40), edge(98.5, 40), edge(50, 1), edge(50, 79), (1.0, 1.0, 0.0), edge(50, 40, -2.0)]
    df, k, here, w, h = shots(spark, points)
    rows = [r.s for r in df.select(P.project(here, k, w, h).alias("s")).collect()]
    assert [r.valid for r in rows] == [True, False, False, True, False, True, False, False, False, False]
    assert rows[8].u is None and len(rows) == len(points)
    assert math.isclose(rows[3].u, 1.5)


def test_unnormalised_projection_and_wide_intrinsics(spark):
    df, k, here, w, h = shots(spark, [(1.0, 2.0, 4.0)])
    s = df.select(P.project(here, k, w, h, normalize=False).alias("s")).first()["s"]
    assert (s.u, s.v) == (10.0 + 200.0, 20.0 + 160.0)
    with pytest.raises(ValueError):
        P.projection_matrix(F.lit(None), rows=5)


def test_clipped_projection(spark):
    df, k, here, w, h = shots(spark, [(2.0, 0.0, 0.0), (1.0, 99.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 1.0)])
    rows = [tuple(r.s) for r in df.select(P.project_clipped(here, k, w, h).alias("s")).collect()]
    assert rows == [(50.0, 40.0, 1), (0.0, 40.0, 1), (0.0, 0.0, 0), (0.0, 0.0, 0)]


def test_box_corners(spark):
    box = (1.0, 2.0, 3.0, 4.0, 2.0, 6.0, 0.7)
    df = spark.createDataFrame([box], "x DOUBLE, y DOUBLE, z DOUBLE, length DOUBLE, width DOUBLE, height DOUBLE, yaw DOUBLE")
    got = [[r.corner_x, r.corner_y, r.corner_z] for r in G.box_corners(df).orderBy("corner").collect()]
    x, y, z, length, width, height, yaw = box
    rot = np.array([[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]])
    want = []
    for dz in (-0.5, 0.5):
        for sl in (-0.5, 0.5):
            for sw in (-0.5, 0.5):
                dx, dy = rot @ [sl * length, sw * width]
                want.append([x + dx, y + dy, z + dz * height])
    assert np.allclose(got, want)


def test_project_clouds_keeps_every_point_and_aligns_labels(spark):
    pose = lambda: F.struct(F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)]).alias("rotation"), F.array(*[F.lit(0.0)] * 3).alias("translation"))
    lidar = spark.createDataFrame(
        [(1, 7, [(0.0, 0.0, 5.0), (0.0, 0.0, -5.0), (1.0, 0.0, 5.0)])],
        "weather_uid INT, lidar_uid INT, points ARRAY<STRUCT<x: FLOAT, y: FLOAT, z: FLOAT>>",
    ).withColumn("lidar_vehicle_pose", pose())
    k = F.array(*[F.array(*[F.lit(v) for v in r]) for r in [(10.0, 0.0, 50.0), (0.0, 10.0, 40.0), (0.0, 0.0, 1.0)]])
    size = F.struct(F.lit(100).alias("width"), F.lit(80).alias("height"))
    camera = spark.createDataFrame([(1, 8), (1, 9), (2, 10)], "weather_uid INT, camera_uid INT").withColumns(
        {"camera_vehicle_pose": pose(), "camera_parameters": pose().withField("intrinsic", k).withField("resolution", size)}
    )
    labels = spark.createDataFrame([(7, [3, 4, 3])], "lidar_uid INT, lidar_segmentation ARRAY<SMALLINT>")
    shot = G.project_clouds(lidar, camera, labels)
    assert shot.count() == 6
    assert sorted(map(tuple, G.visible_by_label(shot).collect())) == [(8, 3, 2), (9, 3, 2)]
