"""Flattening of token-linked JSON tables (nuScenes and nuImages layout)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.pose import (
    conjugate,
    matrix_product,
    move,
    pose_matrix,
    projection_matrix,
    quaternion_product,
    rotate_columns,
    rotation_angle,
    rotation_matrix,
    translate,
)
from scenelake.functions.taxonomy import NUSCENES
from scenelake.operators.geometry import move_cloud
from scenelake.operators.lookup import require
from scenelake.plans.ordered import ranked
from scenelake.session import materialise
from scenelake.sources.jsonlist import read_json_list

# Only the fields the flattening reads.
TOKEN_TABLES = {
    "sample": "token STRING, timestamp BIGINT, scene_token STRING, next STRING, "
    "key_camera_token STRING, log_token STRING",
    "scene": "token STRING, name STRING, first_sample_token STRING, log_token STRING",
    "log": "token STRING, location STRING",
    "sample_data": "token STRING, sample_token STRING, ego_pose_token STRING, "
    "calibrated_sensor_token STRING, filename STRING, is_key_frame BOOLEAN, width INT, height INT",
    "ego_pose": "token STRING, rotation ARRAY<DOUBLE>, translation ARRAY<DOUBLE>",
    "calibrated_sensor": "token STRING, sensor_token STRING, rotation ARRAY<DOUBLE>, "
    "translation ARRAY<DOUBLE>, camera_intrinsic ARRAY<ARRAY<DOUBLE>>, camera_distortion ARRAY<DOUBLE>",
    "sensor": "token STRING, channel STRING",
    "category": "token STRING, name STRING, index INT",
    "instance": "token STRING, category_token STRING",
    "sample_annotation": "token STRING, sample_token STRING, instance_token STRING, translation ARRAY<DOUBLE>, "
    "size ARRAY<DOUBLE>, rotation ARRAY<DOUBLE>, num_lidar_pts BIGINT",
    "lidarseg": "token STRING, sample_data_token STRING, filename STRING",
}

# The camera channels of a sample, and its lidar.
CAMERA_CHANNELS = (
    "CAM_FRONT",
    "CAM_FRONT_LEFT",
    "CAM_FRONT_RIGHT",
    "CAM_BACK",
    "CAM_BACK_LEFT",
    "CAM_BACK_RIGHT",
)
LIDAR_CHANNEL = "LIDAR_TOP"

# Split names of the scene lists.
SPLIT_NAMES = {"train": "training", "val": "validation"}


def read_tokens(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One token table; its JSON list is cut into byte ranges, so one large file is read by many tasks."""
    return read_json_list(spark, f"{root.rstrip('/')}/{table}.json", TOKEN_TABLES[table])


def lookup(rows: DataFrame, key: str, table: DataFrame, *columns: str, strict: bool = True) -> DataFrame:
    """Add columns of the ``table`` row whose token is ``rows[key]``; an unknown token fails the job."""
    right = table.select(F.col("token").alias(key), *columns)
    return require(rows, right, key, key) if strict else rows.join(right, key)


def scene_splits(scenes: DataFrame, listing: DataFrame) -> DataFrame:
    """Scenes with their split; ``listing`` (name, split) uses the published split names.

    Splits other than train and val leave, as do their scenes.
    """
    named = listing.where(F.col("split").isin(*SPLIT_NAMES))
    pairs = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    return scenes.join(named.select("name", F.element_at(pairs, F.col("split")).alias("split")), "name")


def sample_metadata(sample: DataFrame, scene: DataFrame, log: DataFrame) -> DataFrame:
    """(sample_token, time, location, split) of scene-based samples; ``scene`` carries the split."""
    located = lookup(sample, "scene_token", scene, F.col("log_token").alias("_log"), "split")
    located = lookup(located.drop("log_token").withColumnRenamed("_log", "log_token"), "log_token", log, "location")
    return located.select(
        F.col("token").alias("sample_token"), "scene_token", F.timestamp_micros("timestamp").alias("time"), "location", "split"
    )


def key_camera_metadata(sample: DataFrame, log: DataFrame, split: str) -> DataFrame:
    """The same for samples that name their log and one key camera frame."""
    return lookup(sample, "log_token", log, "location").select(
        F.col("token").alias("sample_token"),
        "key_camera_token",
        F.timestamp_micros("timestamp").alias("time"),
        "location",
        F.lit(split).alias("split"),
    )


def scene_order(sample: DataFrame) -> DataFrame:
    """Samples with their position in the scene; link order and time order are the same."""
    return ranked(sample, ["scene_token"], [F.col("timestamp"), F.col("token")], "position")


def linked_order(spark: SparkSession, scene: DataFrame, sample: DataFrame) -> DataFrame:
    """(scene_token, sample_token, position) by following the ``next`` links from each scene's first sample.

    Pointer doubling: every sample knows an earlier one and the steps between
    them, and each round doubles that reach, so a scene of n samples takes
    log2(n) rounds. A sample with two predecessors, or a scene on a ring of
    links, is an error. ``scene_order`` gives the same for well-formed input
    without rounds.
    """
    links = sample.select("token", "next").where("next IS NOT NULL AND next <> ''")
    before = links.select(F.col("next").alias("node"), F.col("token").alias("up"))
    if not before.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a sample follows two others")
    named = [sample.select("token"), before.select("node"), scene.select("first_sample_token")]
    nodes = reduce(DataFrame.unionAll, named).toDF("node").distinct()
    # A head points to itself in no steps.
    reach = materialise(
        nodes.join(before, "node", "left").select(
            "node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps")
        )
    )
    rounds = reach.count().bit_length() + 1
    for _ in range(rounds):
        further = reach.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        if reach.join(further, "up").where("_steps > 0").isEmpty():
            break
        reach = materialise(
            reach.join(further, "up").select("node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"))
        )
    heads = reach.where("steps = 0").select(F.col("node").alias("up"))
    starts = scene.select(F.col("token").alias("scene_token"), F.col("first_sample_token").alias("node"))
    begun = starts.join(reach, "node").select("scene_token", "up", F.col("steps").alias("_first"))
    if not begun.join(heads, "up", "left_anti").isEmpty():
        raise ValueError("a scene's links form a ring")
    return begun.join(reach, "up").where("steps >= _first").select(
        "scene_token", F.col("node").alias("sample_token"), (F.col("steps") - F.col("_first") + 1).alias("position")
    )


def sensor_frames(sample_data: DataFrame, calibrated: DataFrame, sensor: DataFrame, ego_pose: DataFrame) -> DataFrame:
    """sample_data rows with channel, calibration and vehicle pose."""
    mount = lookup(calibrated, "sensor_token", sensor, "channel").select(
        "token", "channel", "rotation", "translation", "camera_intrinsic", "camera_distortion"
    )
    pose = ego_pose.select("token", F.struct("rotation", "translation").alias("vehicle_pose"))
    out = lookup(sample_data, "calibrated_sensor_token", mount, "channel", "rotation", "translation",
                 "camera_intrinsic", "camera_distortion")
    return lookup(out, "ego_pose_token", pose, "vehicle_pose")


def camera_rows(frames: DataFrame, dataset: str) -> DataFrame:
    """Camera rows of a sample's camera channels; a channel the sample lacks gives no row."""
    parameters = F.struct(
        F.lit(dataset).alias("type"),
        F.col("camera_intrinsic").alias("intrinsic"),
        "rotation",
        "translation",
        F.lit(None).cast("struct<width:int,height:int>").alias("resolution"),
        F.col("camera_distortion").alias("distortion"),
    )
    return frames.where(F.col("channel").isin(*CAMERA_CHANNELS)).select(
        "token",
        "sample_token",
        F.concat(F.lit(f"{dataset}_"), "channel").alias("camera_id"),
        parameters.alias("camera_parameters"),
        F.col("vehicle_pose").alias("camera_vehicle_pose"),
        "filename",
        *[c for c in ("width", "height") if c in frames.columns],
    )


def lidar_rows(frames: DataFrame, dataset: str) -> DataFrame:
    """Lidar rows of the top sensor."""
    parameters = F.struct(F.lit(dataset).alias("type"), "rotation", "translation")
    return frames.where(F.col("channel") == LIDAR_CHANNEL).select(
        "token",
        "sample_token",
        F.lit(f"{dataset}_top").alias("lidar_id"),
        parameters.alias("lidar_parameters"),
        F.col("vehicle_pose").alias("lidar_vehicle_pose"),
        "filename",
    )


def cloud_to_ego(sweeps: DataFrame, points: str = "points", mount: str = "lidar_parameters") -> DataFrame:
    """Sweeps with their sensor-frame clouds moved to the vehicle frame."""
    matrix = pose_matrix(F.col(f"{mount}.rotation"), F.col(f"{mount}.translation"))
    moved = sweeps.withColumn("_mount", matrix)
    return moved.withColumn(points, move_cloud(F.col(points), F.col("_mount"))).drop("_mount")


def annotations(annotation: DataFrame, instance: DataFrame, category: DataFrame) -> DataFrame:
    """World-frame boxes (sample_token, annotation, x, y, z, length, width, height, rotation,
    points_in_box, label) with unified label names; an unknown category fails the job.
    """
    named = lookup(annotation, "instance_token", instance, "category_token")
    named = lookup(named, "category_token", category, "name")
    names = annotation.sparkSession.createDataFrame(list(NUSCENES.items()), "name STRING, label STRING")
    size = F.col("size")
    return require(named, names, "name", "label name").select(
        "sample_token",
        F.col("token").alias("annotation"),
        *[F.col("translation")[i].alias(a) for i, a in enumerate("xyz")],
        size[1].alias("length"),
        size[0].alias("width"),
        size[2].alias("height"),
        "rotation",
        F.col("num_lidar_pts").alias("points_in_box"),
        "label",
    )


def _inverse(pose: str) -> Column:
    return pose_matrix(F.col(f"{pose}.rotation"), F.col(f"{pose}.translation"), inverse=True)


def _seen(boxes: DataFrame) -> DataFrame:
    """Boxes moved by the row's world-to-sensor ``matrix`` and turned by its quaternion ``turn``."""
    center = move(F.col("matrix"), (F.col("x"), F.col("y"), F.col("z")))
    return boxes.withColumns(
        {**dict(zip("xyz", center)), "rotation": quaternion_product(F.col("turn"), F.col("rotation"))}
    )


def lidar_boxes(sweeps: DataFrame, boxes: DataFrame) -> DataFrame:
    """(token, lidar_box): all boxes of each sweep's sample in the vehicle frame, in annotation order; maybe none.

    A sweep's list is bounded by its own sample's annotations.
    """
    placed = sweeps.select(
        "token",
        "sample_token",
        _inverse("lidar_vehicle_pose").alias("matrix"),
        conjugate(F.col("lidar_vehicle_pose.rotation")).alias("turn"),
    ).join(boxes, "sample_token")
    return _lists(
        sweeps,
        _seen(placed),
        "lidar_box",
        ["x", "y", "z", "length", "width", "height", "rotation", "points_in_box", "label"],
    )


def camera_boxes(cameras: DataFrame, boxes: DataFrame) -> DataFrame:
    """(token, camera_box): boxes in the camera frame that lie in front of it and reach into the image.

    ``cameras`` also has width and height. The yaw is the angle of the box's
    rotation, in radians.
    """
    turn = quaternion_product(
        conjugate(F.col("camera_parameters.rotation")), conjugate(F.col("camera_vehicle_pose.rotation"))
    )
    mounted = cameras.select(
        "token",
        "sample_token",
        _inverse("camera_parameters").alias("to_camera"),
        _inverse("camera_vehicle_pose").alias("to_vehicle"),
        turn.alias("turn"),
        projection_matrix(F.col("camera_parameters.intrinsic")).alias("projection"),
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
    ).withColumn("matrix", matrix_product(F.col("to_camera"), F.col("to_vehicle")))
    seen = _seen(mounted.join(boxes, "sample_token"))
    half = lambda i, bit, side: (F.shiftright(i, bit).bitwiseAND(F.lit(1)).cast("double") - 0.5) * F.col(side)

    def corner(i: Column) -> Column:
        offset = (half(i, 0, "length"), half(i, 1, "width"), half(i, 2, "height"))
        at = translate(rotate_columns(F.col("_r"), offset), (F.col("x"), F.col("y"), F.col("z")))
        return F.struct(*[c.alias(a) for a, c in zip("xyz", at)])

    def inside(c: Column) -> Column:
        u, v, w = move(F.col("projection"), (c["x"], c["y"], c["z"]))
        u, v = F.try_divide(u, w), F.try_divide(v, w)
        hit = (c["z"] > 1) & (u > 0) & (u < F.col("image_width")) & (v > 0) & (v < F.col("image_height"))
        return F.coalesce(hit, F.lit(False))

    corners = seen.withColumn("_r", rotation_matrix(F.col("rotation"))).withColumn(
        "corners", F.transform(F.sequence(F.lit(0), F.lit(7)), corner)
    )
    visible = corners.where(F.exists("corners", inside) & F.forall("corners", lambda c: c["z"] > 0.1))
    return _lists(
        cameras,
        visible.withColumn("yaw", rotation_angle(F.col("rotation"))),
        "camera_box",
        ["x", "y", "z", "length", "width", "height", "yaw", "label"],
    )


def _lists(sensors: DataFrame, rows: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """The boxes of every sensor as a list, empty where it has none."""
    entries = F.array_sort(F.collect_list(F.struct("annotation", *fields)))
    held = rows.groupBy("token").agg(entries.alias("_all")).select(
        "token", F.transform("_all", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(column)
    )
    kind = held.schema[column].dataType
    return sensors.select("token").join(held, "token", "left").select(
        "token", F.coalesce(column, F.array().cast(kind)).alias(column)
    )


def key_frames(sample_data: DataFrame) -> DataFrame:
    """Rows that belong to an annotated sample; sensors also record frames in between."""
    return sample_data.where(F.coalesce(F.col("is_key_frame"), F.lit(True)))
