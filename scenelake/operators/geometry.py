"""Poses and projections over clouds and boxes.

Matrices are combined once per sweep; points are exploded last, so a point row
carries one matrix and needs no join of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import pose as P


def explode_points(lidar: DataFrame, *keep: str, points: str = "points") -> DataFrame:
    """One row per point: the kept columns, pt_idx, x, y, z."""
    return lidar.select(*keep, F.posexplode(points).alias("pt_idx", "_p")).select(
        *keep, "pt_idx", *[F.col(f"_p.{a}").cast("double").alias(a) for a in "xyz"]
    )


def _moved(points: DataFrame, where: P.Point) -> DataFrame:
    return points.withColumns(dict(zip("xyz", where)))


def _here() -> P.Point:
    return F.col("x"), F.col("y"), F.col("z")


def transform_points(points: DataFrame, matrix: Column) -> DataFrame:
    """Replace x, y, z by their image under a 4x4 matrix column."""
    return _moved(points, P.move(matrix, _here()))


def rotate_points(points: DataFrame, rotation: Column) -> DataFrame:
    """Row vectors times a 3x3 matrix column."""
    return _moved(points, P.rotate(_here(), rotation))


def translate_points(points: DataFrame, by: Column) -> DataFrame:
    return _moved(points, P.translate(_here(), P.vector(by)))


def points_to_ego(points: DataFrame, rotation: Column, translation: Column, mode: str = "rigid") -> DataFrame:
    return _moved(points, P.lidar_to_ego(_here(), rotation, translation, mode))


def move_cloud(points: Column, matrix: Column) -> Column:
    """Move a whole cloud inside its row, for results stored as clouds again.

    ``matrix`` should be a plain column: it is read for every point.
    """

    def one(p: Column) -> Column:
        return F.struct(*[c.cast("float").alias(a) for a, c in zip("xyz", P.move(matrix, P.xyz(p)))])

    return F.transform(points, one)


def camera_pairs(lidar: DataFrame, camera: DataFrame) -> DataFrame:
    """(lidar_uid, camera_uid, matrix, projection, width, height) for sensors of the same sample.

    Only keys and calibrations meet here; the clouds are joined afterwards.
    """
    to_world = P.pose_matrix(F.col("lidar_vehicle_pose.rotation"), F.col("lidar_vehicle_pose.translation"))
    sweeps = lidar.select("weather_uid", "lidar_uid", to_world.alias("to_world"))

    def inverse(pose: str) -> Column:
        return P.pose_matrix(F.col(f"{pose}.rotation"), F.col(f"{pose}.translation"), inverse=True)

    cameras = camera.select(
        "weather_uid",
        "camera_uid",
        inverse("camera_vehicle_pose").alias("to_vehicle"),
        inverse("camera_parameters").alias("to_camera"),
        P.projection_matrix(F.col("camera_parameters.intrinsic")).alias("projection"),
        F.col("camera_parameters.resolution.width").alias("width"),
        F.col("camera_parameters.resolution.height").alias("height"),
    ).withColumn("from_world", P.matrix_product(F.col("to_camera"), F.col("to_vehicle")))
    return sweeps.join(cameras, "weather_uid").select(
        "lidar_uid",
        "camera_uid",
        P.matrix_product(F.col("from_world"), F.col("to_world")).alias("matrix"),
        "projection",
        "width",
        "height",
    )


def project_clouds(lidar: DataFrame, camera: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Every point of a sweep in every camera of its sample: u, v, valid, and its label if given.

    ``labels`` has (lidar_uid, lidar_segmentation), aligned with the points.
    """
    clouds = lidar.select("lidar_uid", "points")
    label = F.lit(None).cast("smallint")
    if labels is not None:
        clouds = clouds.join(labels.select("lidar_uid", "lidar_segmentation"), "lidar_uid", "left")
        label = F.get(F.col("lidar_segmentation"), F.col("pt_idx"))
    keep = ["lidar_uid", "camera_uid", "matrix", "projection", "width", "height"]
    extra = ["lidar_segmentation"] if labels is not None else []
    rows = clouds.join(camera_pairs(lidar, camera), "lidar_uid").select(
        *keep, *extra, F.posexplode("points").alias("pt_idx", "_p")
    )
    placed = P.move(F.col("matrix"), P.xyz(F.col("_p")))
    shot = P.project(placed, F.col("projection"), F.col("width"), F.col("height"))
    return rows.select("lidar_uid", "camera_uid", "pt_idx", label.alias("label"), shot.alias("_s")).select(
        "lidar_uid", "camera_uid", "pt_idx", "label", "_s.*"
    )


def visible_by_label(projected: DataFrame) -> DataFrame:
    """Visible points per camera and label."""
    return projected.where("valid").groupBy("camera_uid", "label").agg(F.count("*").alias("n_points"))


def box_corners(boxes: DataFrame, *keep: str) -> DataFrame:
    """Eight rows per box, bottom corners first."""
    rows = boxes.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    corner = P.box_corner(F.col("corner"))
    return rows.select(*keep, "corner", *[c.alias(f"corner_{a}") for a, c in zip("xyz", corner)])


def box_to_ego(box: Column, rotation: Column, translation: Column) -> Column:
    """Sensor-frame box struct with its center and orientation in the vehicle frame."""
    center = P.translate(
        P.rotate_columns(P.rotation_cells(rotation), (box["x"], box["y"], box["z"])), P.vector(translation)
    )
    turned = P.quaternion_product(rotation, box["rotation"])
    return box.withField("x", center[0]).withField("y", center[1]).withField("z", center[2]).withField(
        "rotation", turned
    )
