"""Flattening of decoded frames (Waymo layout): one nested row per frame into sensor rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.pose import quaternion_of, translation_of
from scenelake.functions.taxonomy import WAYMO_BOX, WAYMO_CAMERA, WAYMO_LIDAR
from scenelake.operators.clouds import box_counts, usable_sweeps, valid_returns
from scenelake.operators.labels import remap_labels

# A frame as decoded from its record; transforms are 4x4 in row order.
FRAME = """
    timestamp_micros BIGINT, location STRING, weather STRING, time_of_day STRING, pose ARRAY<DOUBLE>,
    images ARRAY<STRUCT<name: INT, image: BINARY, semantic: STRUCT<height: INT, width: INT, labels: ARRAY<INT>>>>,
    camera_labels ARRAY<STRUCT<name: INT, labels: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, length: DOUBLE,
        width: DOUBLE, type: STRING>>>>,
    camera_calibrations ARRAY<STRUCT<name: INT, intrinsic: ARRAY<DOUBLE>, extrinsic: ARRAY<DOUBLE>,
        width: INT, height: INT>>,
    lasers ARRAY<STRUCT<name: INT, points: ARRAY<STRUCT<x: FLOAT, y: FLOAT, z: FLOAT>>,
        features: ARRAY<ARRAY<FLOAT>>, ranges: ARRAY<DOUBLE>, labels: ARRAY<INT>>>,
    laser_calibrations ARRAY<STRUCT<name: INT, extrinsic: ARRAY<DOUBLE>>>,
    laser_labels ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, length: DOUBLE, width: DOUBLE,
        height: DOUBLE, yaw: DOUBLE, type: STRING>>
"""


def _box_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in WAYMO_BOX.items() for x in kv])
    error = F.raise_error(F.concat(F.lit("no label for "), kind)).cast("string")
    return F.coalesce(F.try_element_at(names, kind), error)


def _pose(transform: Column) -> Column:
    return F.struct(quaternion_of(transform, 4).alias("rotation"), translation_of(transform).alias("translation"))


def sample_rows(frames: DataFrame, split: str) -> DataFrame:
    """One weather row per frame; values are taken over as recorded."""
    return frames.select(
        F.timestamp_micros("timestamp_micros").alias("time"),
        "location",
        "weather",
        F.col("time_of_day").alias("tod"),
        F.lit("waymo").alias("dataset"),
        F.lit(split).alias("split"),
        _seq("location"),
    )


def _seq(*parts: str) -> Column:
    """Name of a row within its batch; a repeated key takes the highest."""
    return F.concat_ws("-", F.lpad(F.col("timestamp_micros").cast("string"), 20, "0"), *parts).alias("seq")


def _own(entries: Column, name: Column) -> Column:
    """First entry of a per-sensor list that belongs to sensor ``name``, else NULL."""
    return F.get(F.filter(entries, lambda e: e["name"] == name), F.lit(0))


def image_rows(frames: DataFrame, ids: dict[str, int]) -> DataFrame:
    """One row per image: own calibration, own boxes (empty when it has none), unified raster."""
    rows = frames.select(
        F.timestamp_micros("timestamp_micros").alias("time"),
        "location",
        "timestamp_micros",
        "pose",
        "camera_labels",
        "camera_calibrations",
        F.explode("images").alias("im"),
    ).select(
        "*",
        _own(F.col("camera_calibrations"), F.col("im.name")).alias("mount"),
        _own(F.col("camera_labels"), F.col("im.name")).alias("own_labels"),
    )
    mount, labels = F.col("mount"), F.col("own_labels")
    boxes = F.transform(
        F.coalesce(labels["labels"], F.array()),
        lambda b: F.struct(b["x"], b["y"], b["length"], b["width"], _box_name(b["type"]).alias("label")),
    )
    intrinsic = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.slice(mount["intrinsic"], r * 3 + 1, 3))
    parameters = F.struct(
        F.lit("waymo").alias("type"),
        intrinsic.alias("intrinsic"),
        quaternion_of(mount["extrinsic"], 4).alias("rotation"),
        translation_of(mount["extrinsic"]).alias("translation"),
        F.struct(mount["width"].alias("width"), mount["height"].alias("height")).alias("resolution"),
        F.lit(None).cast("array<double>").alias("distortion"),
    )
    pairs = {i: ids[unified] for i, (_, unified) in enumerate(WAYMO_CAMERA)}
    semantic = F.struct(
        "im.semantic.height", "im.semantic.width", remap_labels(F.col("im.semantic.labels"), pairs).alias("labels")
    )
    return rows.select(
        "time",
        "location",
        F.concat(F.lit("waymo_"), F.col("im.name").cast("string")).alias("camera_id"),
        F.col("im.image").alias("image"),
        F.when(mount.isNotNull(), parameters).alias("camera_parameters"),
        _pose(F.col("pose")).alias("camera_vehicle_pose"),
        boxes.alias("camera_box"),
        _seq("location", "im.name"),
        F.when(F.size("im.semantic.labels") > 0, semantic).alias("camera_segmentation"),
    )


def lidar_rows(frames: DataFrame, ids: dict[str, int]) -> DataFrame:
    """One row per usable laser, with its own calibration, unified labels and counted boxes.

    Labels are those of valid returns and so line up with the points. A frame
    with boxes keeps all its sweeps, an empty box list included.
    """
    rows = frames.select(
        F.timestamp_micros("timestamp_micros").alias("time"),
        "location",
        "timestamp_micros",
        "pose",
        "laser_labels",
        "laser_calibrations",
        F.explode("lasers").alias("las"),
    ).select(
        "*",
        F.concat(F.lit("waymo_"), F.col("las.name").cast("string")).alias("lidar_id"),
        _own(F.col("laser_calibrations"), F.col("las.name")).alias("mount"),
        valid_returns(F.col("las.ranges"), F.col("las.labels")).alias("raw"),
    )
    raw, mount = F.col("raw"), F.col("mount")
    labelled = F.exists(raw, lambda x: x != 0)
    pairs = {i: ids[unified] for i, (_, unified) in enumerate(WAYMO_LIDAR)}
    parameters = F.struct(
        F.lit("waymo").alias("type"),
        quaternion_of(mount["extrinsic"], 4).alias("rotation"),
        translation_of(mount["extrinsic"]).alias("translation"),
    )
    sweeps = rows.select(
        "time",
        "location",
        "lidar_id",
        F.col("las.points").alias("points"),
        F.col("las.features").alias("features"),
        parameters.alias("lidar_parameters"),
        _pose(F.col("pose")).alias("lidar_vehicle_pose"),
        F.when(labelled, remap_labels(raw, pairs)).alias("lidar_segmentation"),
        "laser_labels",
        _seq("location", "las.name"),
    )
    return (
        box_counts(sweeps, "points", "laser_labels")
        .withColumn("lidar_box", F.when(F.size("laser_labels") > 0, _held_boxes()))
        .transform(usable_sweeps)
        .drop("laser_labels", "counts")
    )


_BOXES = (
    "array<struct<x:double,y:double,z:double,length:double,width:double,height:double,yaw:double,"
    "points_in_box:bigint,label:string>>"
)


def _held_boxes() -> Column:
    """The frame's boxes that hold points of the sweep, with their counts."""
    pairs = F.arrays_zip(F.col("laser_labels").alias("b"), F.col("counts").alias("n"))
    box = lambda p: F.struct(
        *[p["b"][f].alias(f) for f in ("x", "y", "z", "length", "width", "height", "yaw")],
        p["n"].alias("points_in_box"),
        _box_name(p["b"]["type"]).alias("label"),
    )
    return F.transform(F.filter(pairs, lambda p: p["n"] > 0), box).cast(_BOXES)
