"""A small catalog with the awkward cases."""

from datetime import datetime, timedelta

from scenelake import Catalog, schemas

T0 = datetime(2020, 1, 1, 12, 0, 0)


def weather_rows():
    at = lambda s: T0 + timedelta(seconds=s)
    return [
        (1, at(0), "rain", "boston-seaport", "Day", "training", "waymo", None),
        (2, at(0), "Clear Sky", "location_sf", "day", "training", "nuscenes", ""),
        (3, at(60), "Fog", "boston-seaport", "Night", "validation", "waymo", None),
        (4, at(10), "Light Snow", "location_sf", "dusk", "testing", "nuimages", "done"),
        (5, at(5), "Overcast", "boston-seaport", "night", "training", "waymo", None),
    ]


def catalog(spark, trusted=False):
    weather = spark.createDataFrame(weather_rows(), schemas.table_schema("weather"))
    camera = spark.createDataFrame(
        [(uid, w, cid, bytes([uid])) for uid, w, cid in [(10, 1, "a"), (11, 1, "b"), (12, 1, "c"), (13, 2, "a"), (14, 3, "a")]],
        "camera_uid BIGINT, weather_uid BIGINT, camera_id STRING, image BINARY",
    )
    lidar = spark.createDataFrame(
        [(20, 1, "top"), (21, 1, "front"), (22, 2, "top")], "lidar_uid BIGINT, weather_uid BIGINT, lidar_id STRING"
    )
    box = spark.createDataFrame([(10, "x"), (13, "y")], "camera_uid BIGINT, camera_box STRING")
    alone = spark.createDataFrame([(1,)], "z INT")
    tables = {"weather": weather, "camera": camera, "lidar": lidar, "camera_box": box, "alone": alone}
    return Catalog(tables, schemas.KEYS, schemas.FOREIGN_KEYS, trusted)
