"""One call per source: everything ``store_batch`` takes, from a source's own files or frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.taxonomy import NUSCENES
from scenelake.operators.labels import remap_labels, token_pairs
from scenelake.operators.weather import enrich
from scenelake.session import materialise
from scenelake.sources import files, frames, payloads, tokens


def waymo_batch(decoded: DataFrame, split: str, ids: Mapping[str, int]) -> dict[str, DataFrame]:
    """Samples, cameras and lidars of decoded frames."""
    return {
        "weather": frames.sample_rows(decoded, split),
        "camera": frames.image_rows(decoded, dict(ids)),
        "lidar": frames.lidar_rows(decoded, dict(ids)),
    }


def _placed(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Sensor rows with their sample's key; the source's token orders repeated ones."""
    keys = samples.select("sample_token", "time", "location")
    return rows.withColumn("seq", F.col("token")).join(keys, "sample_token")


def nuscenes_batch(
    spark: SparkSession,
    root: str,
    listing: DataFrame,
    archive: DataFrame,
    ids: Mapping[str, int],
    lidarseg: bool = True,
    marks: str = "bin",
) -> dict[str, DataFrame]:
    """Scenes of the splits in ``listing`` (name, split), from the token tables and files below ``root``.

    ``archive`` is the hourly weather, ``ids`` the unified label ids. Point
    labels are looked up by token in the lidarseg table; their files end in
    ``marks``.
    """
    t = {name: tokens.read_tokens(spark, root, name) for name in tokens.TOKEN_TABLES if lidarseg or name != "lidarseg"}
    scenes = tokens.scene_splits(t["scene"], listing)
    inside = t["sample"].join(scenes.select(F.col("token").alias("scene_token")), "scene_token", "left_semi")
    samples = materialise(
        enrich(tokens.sample_metadata(inside, scenes, t["log"]), archive)
        .withColumns({"dataset": F.lit("nuscenes"), "seq": F.col("sample_token")})
    )
    data = tokens.sensor_frames(
        tokens.key_frames(t["sample_data"]), t["calibrated_sensor"], t["sensor"], t["ego_pose"]
    ).join(samples.select("sample_token"), "sample_token", "left_semi")
    boxes = tokens.annotations(t["sample_annotation"], t["instance"], t["category"])
    cameras = tokens.camera_rows(data, "nuscenes")
    cameras = files.attach_blobs(spark, cameras, root, "jpg").join(tokens.camera_boxes(cameras, boxes), "token")
    tops = tokens.lidar_rows(data, "nuscenes")
    flat = files.attach_blobs(spark, tops, root, "bin", "points").withColumn("flat", payloads.flat_cloud_file("points"))
    sweeps = tokens.cloud_to_ego(
        flat.withColumns({"points": payloads.points(F.col("flat")), "features": payloads.features(F.col("flat"))})
    ).join(tokens.lidar_boxes(tops, boxes), "token")
    if lidarseg:
        # The category table has a few dozen rows.
        names = {r["index"]: r["name"] for r in t["category"].where("index IS NOT NULL").collect()}
        pairs = token_pairs(names, NUSCENES, ids)
        named = t["lidarseg"].select(F.col("sample_data_token").alias("token"), "filename")
        raw = files.attach_blobs(spark, named.join(tops.select("token"), "token", "left_semi"), root, marks, "marks")
        raster = remap_labels(payloads.labels(payloads.flat_label_file("marks")), pairs)
        sweeps = sweeps.join(raw.select("token", raster.alias("lidar_segmentation")), "token", "left")
    return {"weather": samples, "camera": _placed(cameras, samples), "lidar": _placed(sweeps.drop("flat"), samples)}


def nuimages_batch(
    spark: SparkSession, root: str, split: str, archive: DataFrame, ids: Mapping[str, int], masks: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Key camera images of samples without scenes.

    ``masks`` (token, height, width, labels) holds rendered rasters by
    sample_data token in the source's category numbers; number 0 is void.
    """
    t = {n: tokens.read_tokens(spark, root, n) for n in ("sample", "log", "sample_data", "calibrated_sensor", "sensor", "ego_pose", "category")}
    meta = tokens.key_camera_metadata(t["sample"], t["log"], split)
    samples = materialise(
        enrich(meta, archive).withColumns({"dataset": F.lit("nuimages"), "seq": F.col("sample_token")})
    )
    keys = samples.select(F.col("key_camera_token").alias("token"))
    data = tokens.sensor_frames(
        t["sample_data"].join(keys, "token", "left_semi"), t["calibrated_sensor"], t["sensor"], t["ego_pose"]
    )
    cameras = files.attach_blobs(spark, tokens.camera_rows(data, "nuimages"), root, "jpg")
    if masks is not None:
        # Categories are numbered by their order of names, from 1.
        names = sorted(r["name"] for r in t["category"].collect())
        pairs = {0: ids["void"], **{i: ids[NUSCENES[n]] for i, n in enumerate(names, 1) if n in NUSCENES}}
        raster = F.struct("height", "width", remap_labels(F.col("labels"), pairs).alias("labels"))
        cameras = cameras.drop("height", "width").join(
            masks.select("token", raster.alias("camera_segmentation")), "token", "left"
        )
    return {"weather": samples, "camera": _placed(cameras, samples)}
