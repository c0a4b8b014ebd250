"""Table schemas, keys and foreign keys of the scene catalog."""

from __future__ import annotations

from pyspark.sql import types as T

from scenelake.plans.catalog import ForeignKey

_XYZ = "ARRAY<STRUCT<x: FLOAT, y: FLOAT, z: FLOAT>>"
_FLOATS2D = "ARRAY<ARRAY<FLOAT>>"
_POSE = "STRUCT<rotation: ARRAY<DOUBLE>, translation: ARRAY<DOUBLE>>"
_BOX = "x: DOUBLE, y: DOUBLE, z: DOUBLE, length: DOUBLE, width: DOUBLE, height: DOUBLE, yaw: DOUBLE"
_SCORES = "iou FLOAT, ece FLOAT, model STRING"

CAMERA_BOX = f"ARRAY<STRUCT<{_BOX}, label: STRING>>"
LIDAR_BOX = f"ARRAY<STRUCT<{_BOX}, rotation: ARRAY<DOUBLE>, points_in_box: BIGINT, label: STRING>>"
CAMERA_PARAMETERS = (
    "STRUCT<type: STRING, intrinsic: ARRAY<ARRAY<DOUBLE>>, rotation: ARRAY<DOUBLE>, translation: ARRAY<DOUBLE>, "
    "resolution: STRUCT<width: INT, height: INT>, distortion: ARRAY<DOUBLE>>"
)
LIDAR_PARAMETERS = "STRUCT<type: STRING, rotation: ARRAY<DOUBLE>, translation: ARRAY<DOUBLE>>"

# Column definitions, as CREATE TABLE and the readers take them.
TABLES: dict[str, str] = {
    "weather": "weather_uid BIGINT NOT NULL, time TIMESTAMP NOT NULL, weather STRING NOT NULL, "
    "location STRING NOT NULL, tod STRING NOT NULL, split STRING NOT NULL, dataset STRING NOT NULL, custom STRING",
    "camera": "camera_uid BIGINT NOT NULL, weather_uid BIGINT NOT NULL, camera_id STRING NOT NULL, "
    "image BINARY NOT NULL, semantic_labels BINARY, instance_labels BINARY, panoptic_labels BINARY, "
    f"camera_parameters {CAMERA_PARAMETERS}, camera_vehicle_pose {_POSE}",
    "lidar": "lidar_uid BIGINT NOT NULL, weather_uid BIGINT NOT NULL, lidar_id STRING NOT NULL, "
    f"points {_XYZ} NOT NULL, points_downsampled {_XYZ}, features {_FLOATS2D}, features_downsampled {_FLOATS2D}, "
    f"lidar_parameters {LIDAR_PARAMETERS}, lidar_vehicle_pose {_POSE}",
    "camera_segmentation": "camera_uid BIGINT NOT NULL, "
    "camera_segmentation STRUCT<height: INT, width: INT, labels: ARRAY<SMALLINT>>",
    "lidar_segmentation": "lidar_uid BIGINT NOT NULL, lidar_segmentation ARRAY<SMALLINT>, "
    "lidar_segmentation_downsampled ARRAY<SMALLINT>",
    "camera_box": f"camera_uid BIGINT NOT NULL, camera_box {CAMERA_BOX}",
    "lidar_box": f"lidar_uid BIGINT NOT NULL, lidar_box {LIDAR_BOX}",
    "results_camera_segmentation": f"camera_uid BIGINT NOT NULL, prediction {_FLOATS2D}, {_SCORES}",
    "results_lidar_segmentation": f"lidar_uid BIGINT NOT NULL, prediction {_FLOATS2D}, "
    f"prediction_downsampled {_FLOATS2D}, iou FLOAT, iou_downsampled FLOAT, ece FLOAT, ece_downsampled FLOAT, "
    "model STRING",
}

# Storage partition of each table: column, type, and the expression giving it. A batch of new
# recordings lands in few partitions, so a merge rewrites those and nothing else.
SAMPLES_PER_BLOCK = 10_000
SENSOR_ROWS_PER_BLOCK = 100_000


def _block(uid: str, rows: int) -> tuple[str, str, str]:
    return "block", "BIGINT", f"CAST(floor({uid} / {rows}) AS BIGINT)"


PARTITIONS: dict[str, tuple[str, str, str]] = {
    "weather": ("day", "DATE", "to_date(time)"),
    "camera": _block("weather_uid", SAMPLES_PER_BLOCK),
    "lidar": _block("weather_uid", SAMPLES_PER_BLOCK),
    "camera_segmentation": _block("camera_uid", SENSOR_ROWS_PER_BLOCK),
    "camera_box": _block("camera_uid", SENSOR_ROWS_PER_BLOCK),
    "results_camera_segmentation": _block("camera_uid", SENSOR_ROWS_PER_BLOCK),
    "lidar_segmentation": _block("lidar_uid", SENSOR_ROWS_PER_BLOCK),
    "lidar_box": _block("lidar_uid", SENSOR_ROWS_PER_BLOCK),
    "results_lidar_segmentation": _block("lidar_uid", SENSOR_ROWS_PER_BLOCK),
}

# Surrogate key of each table.
KEYS: dict[str, tuple[str, ...]] = {
    "weather": ("weather_uid",),
    "camera": ("camera_uid",),
    "lidar": ("lidar_uid",),
    "camera_segmentation": ("camera_uid",),
    "lidar_segmentation": ("lidar_uid",),
    "camera_box": ("camera_uid",),
    "lidar_box": ("lidar_uid",),
    "results_camera_segmentation": ("camera_uid",),
    "results_lidar_segmentation": ("lidar_uid",),
}

# Natural key an upsert matches on, unique per table.
NATURAL_KEYS: dict[str, tuple[str, ...]] = {
    "weather": ("time", "location"),
    "camera": ("weather_uid", "camera_id"),
    "lidar": ("weather_uid", "lidar_id"),
}


def _fk(child: str, parent: str, column: str) -> ForeignKey:
    return ForeignKey(child, (column,), parent, (column,))


FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    _fk("camera", "weather", "weather_uid"),
    _fk("lidar", "weather", "weather_uid"),
    _fk("camera_segmentation", "camera", "camera_uid"),
    _fk("camera_box", "camera", "camera_uid"),
    _fk("results_camera_segmentation", "camera", "camera_uid"),
    _fk("lidar_segmentation", "lidar", "lidar_uid"),
    _fk("lidar_box", "lidar", "lidar_uid"),
    _fk("results_lidar_segmentation", "lidar", "lidar_uid"),
)


def table_schema(table: str) -> T.StructType:
    """Schema of a scene table; needs an active Spark session."""
    return T.StructType.fromDDL(TABLES[table])
