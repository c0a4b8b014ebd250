"""Lookups, enrichment, interval and sidecar joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenelake.functions.dims import WMO_CODES
from scenelake.operators import labeling, weather
from scenelake.operators.labels import chain_maps
from scenelake.session import shared_dir
from scenelake.sources import files, tokens
from scenelake.sources.jsonlist import read_json_list
from scenelake.functions.sun import twilight
from workload.registry import PLACES, place, query, table, view, view_sql
from workload.sqlmath import sun_sql

_CODES = "[" + ", ".join(str(c) for c in WMO_CODES) + "]"


@query(
    "token_lookup",
    "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS log_token, c_name AS location "
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey",
)
def token_lookup(spark, sf_dir):
    """Sample to scene to log, on line, order and customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    scenes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("log_token"))
    logs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("token"), F.col("c_name").alias("location"))
    found = tokens.lookup(lines.withColumn("scene_token", F.col("l_orderkey")), "scene_token", scenes, "log_token")
    return tokens.lookup(found, "log_token", logs, "location").drop("scene_token")


def _token_list(df, path):
    """Write one JSON list per partition, as token tables are stored; strings keep their quotes and brackets."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    spans = df.select(row.alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    first, last = (F.col("id") == x("id").over(Window.partitionBy("part")) for x in (F.min, F.max))
    lines = F.concat(F.when(first, "[\n").otherwise(",\n"), "row", F.when(last, "\n]").otherwise(""))
    spans.withColumn("line", lines).sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)


@query(
    "token_list",
    "SELECT event_id, user_id AS scene_token, event_type, props AS deep, c_name AS location "
    "FROM events JOIN customer ON c_custkey = user_id",
)
def token_list(spark, sf_dir):
    """Token tables stored as JSON lists, read in byte ranges and looked up."""
    folder = f"{shared_dir(spark)}/token-lists/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS scene_token", "event_type", "props AS deep")
    logs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS token", "c_name AS location")
    _token_list(events, f"{folder}/sample.json")
    _token_list(logs, f"{folder}/log.json")
    read = lambda name, schema: read_json_list(spark, f"{folder}/{name}.json", schema, 1 << 18)
    samples = read("sample", "event_id BIGINT, scene_token BIGINT, event_type STRING, deep STRING")
    named = read("log", "token BIGINT, location STRING").withColumnRenamed("token", "scene_token")
    return samples.join(named, "scene_token")


_CHANNELS = [*tokens.CAMERA_CHANNELS, tokens.LIDAR_CHANNEL]


@query(
    "channel_expand",
    "WITH sd AS (SELECT *, ["
    + ", ".join(f"'{c}'" for c in _CHANNELS)
    + "][l_linenumber] AS channel FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) "
    "SELECT l_orderkey AS sample_token, l_partkey AS token, 'nuscenes_' || channel AS camera_id, "
    "s_acctbal AS first_rotation FROM sd WHERE channel <> 'LIDAR_TOP'",
)
def channel_expand(spark, sf_dir):
    """Camera rows of every sample: line numbers are channels, suppliers the mounted sensors."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("token"),
        F.col("l_orderkey").alias("sample_token"),
        F.col("l_suppkey").alias("calibrated_sensor_token"),
        F.col("l_suppkey").alias("ego_pose_token"),
        F.get(F.lit(_CHANNELS), F.col("l_linenumber") - 1).alias("channel"),
        F.lit("").alias("filename"),
    )
    mounts = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("token"),
        F.array(F.col("s_acctbal"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("rotation"),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("translation"),
    )
    poses = mounts.select("token", F.struct("rotation", "translation").alias("vehicle_pose"))
    frames = tokens.lookup(lines, "calibrated_sensor_token", mounts, "rotation", "translation")
    frames = tokens.lookup(frames, "ego_pose_token", poses, "vehicle_pose").withColumns(
        {"camera_intrinsic": F.lit(None).cast("array<array<double>>"), "camera_distortion": F.lit(None).cast("array<double>")}
    )
    return tokens.camera_rows(frames, "nuscenes").select(
        "sample_token", "token", "camera_id", F.get("camera_parameters.rotation", 0).alias("first_rotation")
    )


@query(
    "loc_gps",
    view_sql("samples")
    + ", places(location, lat, lon) AS (VALUES "
    + ", ".join(f"('{p}', {lat!r}::DOUBLE, {lon!r}::DOUBLE)" for p, (lat, lon) in PLACES.items())
    + ") SELECT weather_uid, lat, lon FROM samples JOIN places USING (location)",
)
def loc_gps(spark, sf_dir):
    return weather.with_gps(view(spark, sf_dir, "samples")).select("weather_uid", "lat", "lon")


def _archive(spark, sf_dir):
    """Hourly weather per place, from how many events fell into the hour."""
    frames = view(spark, sf_dir, "frames")
    hours = frames.groupBy("location", F.date_trunc("hour", "time").alias("hour")).agg(F.count("*").alias("n"))
    at = F.pmod(F.col("n") * 7 + F.hour("hour"), F.lit(len(WMO_CODES)))
    return hours.select(
        "location",
        "hour",
        F.get(F.lit(list(WMO_CODES)), at.cast("int")).alias("weather_code"),
        F.when(F.hour("hour").between(6, 17), 1).otherwise(0).alias("is_day"),
    )


_ARCHIVE_SQL = view_sql("frames") + f""",
hours AS (SELECT location, date_trunc('hour', time) AS hour, count(*) AS n FROM frames GROUP BY 1, 2),
archive AS (SELECT location, hour, {_CODES}[(n * 7 + hour(hour)) % {len(WMO_CODES)} + 1] AS weather_code,
    CASE WHEN hour(hour) BETWEEN 6 AND 17 THEN 1 ELSE 0 END AS is_day FROM hours),
coded AS (SELECT f.weather_uid, f.time, f.location, a.weather_code, a.is_day FROM frames f
    JOIN archive a ON a.location = f.location AND a.hour = date_trunc('hour', f.time))
"""


@query("hourly_enrich", _ARCHIVE_SQL + "SELECT weather_uid, weather_code, is_day FROM coded")
def hourly_enrich(spark, sf_dir):
    return weather.with_hourly_weather(view(spark, sf_dir, "frames"), _archive(spark, sf_dir)).select(
        "weather_uid", "weather_code", "is_day"
    )


_WMO_SQL = ", wmo(code, text) AS (VALUES " + ", ".join(f"({c}, '{t}')" for c, t in WMO_CODES.items()) + ") "


@query(
    "wmo_decode",
    _ARCHIVE_SQL + _WMO_SQL + "SELECT weather_uid, text AS weather FROM coded JOIN wmo ON code = weather_code",
)
def wmo_decode(spark, sf_dir):
    coded = weather.with_hourly_weather(view(spark, sf_dir, "frames"), _archive(spark, sf_dir))
    return weather.with_weather_text(coded).select("weather_uid", "weather")


_SUN = sun_sql("events", "event_id, user_id, ts", "epoch_us(ts)", "user_id")


@query(
    "twilight",
    "WITH " + _SUN + "SELECT event_id, CASE WHEN now > sets AND now < dusk THEN 'dusk' "
    "WHEN now > dawn AND now < rise THEN 'dawn' ELSE '' END AS twilight, "
    "round(rise, 5) AS sunrise, round(dusk, 5) AS dusk FROM sun",
)
def twilight_of(spark, sf_dir):
    from scenelake.functions.sun import sun_times

    located = weather.with_gps(view(spark, sf_dir, "frames"))
    at = labeling.micros("time"), F.col("lat"), F.col("lon")
    times = sun_times(*at)
    return located.select(
        F.col("weather_uid").alias("event_id"),
        F.coalesce(twilight(*at), F.lit("")).alias("twilight"),
        F.round(times["sunrise"], 5).alias("sunrise"),
        F.round(times["dusk"], 5).alias("dusk"),
    )


@query(
    "tod",
    _ARCHIVE_SQL + _WMO_SQL + "," + _SUN + "SELECT weather_uid, text AS weather, CASE WHEN now > sets AND now < dusk "
    "THEN 'dusk' WHEN now > dawn AND now < rise THEN 'dawn' WHEN is_day = 0 THEN 'night' ELSE 'day' END AS tod "
    "FROM coded JOIN wmo ON code = weather_code JOIN sun ON event_id = weather_uid",
)
def enriched(spark, sf_dir):
    """Weather text and time of day of every frame, from place and time alone."""
    frames = view(spark, sf_dir, "frames").drop("custom")
    return weather.enrich(frames, _archive(spark, sf_dir)).select("weather_uid", "weather", "tod")


@query(
    "scene_split",
    "SELECT c_custkey AS token, CASE c_custkey % 4 WHEN 0 THEN 'validation' ELSE 'training' END AS split "
    "FROM customer WHERE c_custkey % 4 <> 3",
)
def scene_split(spark, sf_dir):
    scenes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("token"), F.col("c_name").alias("name"))
    published = F.get(F.lit(["val", "train", "train", "test"]), F.pmod("token", F.lit(4)).cast("int"))
    listing = scenes.select("name", published.alias("split"))
    return tokens.scene_splits(scenes, listing).select("token", "split")


@query(
    "label_chain",
    "SELECT c_custkey AS source, r_name AS target FROM customer JOIN nation ON n_nationkey = c_nationkey "
    "JOIN region ON r_regionkey = n_regionkey",
)
def label_chain(spark, sf_dir):
    def pairs(name, source, target):
        return table(spark, sf_dir, name).select(F.col(source).alias("source"), F.col(target).alias("target"))

    return chain_maps(
        pairs("customer", "c_custkey", "c_nationkey"),
        pairs("nation", "n_nationkey", "n_regionkey"),
        pairs("region", "r_regionkey", "r_name"),
    )


# -- labeling ---------------------------------------------------------------


@query(
    "unlabeled",
    view_sql("frames") + "SELECT weather_uid, location FROM frames WHERE custom IS NULL OR custom = ''",
)
def unlabeled(spark, sf_dir):
    return labeling.unlabeled(view(spark, sf_dir, "frames")).select("weather_uid", "location")


@query(
    "unlabeled_next",
    view_sql("frames") + "SELECT location, arg_min(weather_uid, (time, weather_uid)) AS weather_uid FROM frames "
    "WHERE custom IS NULL OR custom = '' GROUP BY location",
)
def unlabeled_next(spark, sf_dir):
    return labeling.next_unlabeled(view(spark, sf_dir, "frames")).select("location", "weather_uid")


def _propagate_sql(seconds: int) -> str:
    return view_sql("frames", "label_events") + f""",
    won AS (SELECT f.weather_uid, arg_max(e.label, e.seq) AS label FROM frames f JOIN label_events e
        ON e.location = f.location AND f.time >= e.time AND f.time <= e.time + INTERVAL {seconds} SECONDS
        GROUP BY f.weather_uid)
    SELECT f.weather_uid, CASE WHEN w.weather_uid IS NOT NULL THEN w.label ELSE f.custom END AS custom
    FROM frames f LEFT JOIN won w ON w.weather_uid = f.weather_uid"""


def _propagate(seconds: int):
    def run(spark, sf_dir):
        labels = view(spark, sf_dir, "label_events").select("weather_uid", "label", "seq")
        return labeling.apply_labels(view(spark, sf_dir, "frames"), labels, seconds).select("weather_uid", "custom")

    return run


query("label_propagate", _propagate_sql(60))(_propagate(60))
query("label_propagate_hour", _propagate_sql(3600))(_propagate(3600))


def _count_sql(seconds: int) -> str:
    return view_sql("frames", "label_events") + f"""
    SELECT e.seq, count(*) AS labeled_images FROM label_events e JOIN frames f
    ON e.location = f.location AND f.time >= e.time AND f.time <= e.time + INTERVAL {seconds} SECONDS GROUP BY e.seq"""


def _counts(seconds: int):
    def run(spark, sf_dir):
        return labeling.covered_counts(view(spark, sf_dir, "frames"), view(spark, sf_dir, "label_events"), seconds)

    return run


query("label_propagate_count", _count_sql(60))(_counts(60))
query("label_propagate_count_hour", _count_sql(3600))(_counts(3600))


# -- paths ------------------------------------------------------------------

# A label file per page; companions exist depending on the page id.
_STEM = "concat('2018', lpad(CAST(page_id AS STRING), 6, '0'), '_label_frontcenter_', lpad(CAST(page_id AS STRING), 9, '0'))"
_SIDE = {
    "image": ("'camera'", "'_camera_'", "'.png'", 2),
    "image_info": ("'camera'", "'_camera_'", "'.json'", 3),
    "lidar": ("'lidar'", "'_lidar_'", "'.npz'", 5),
    "boxes": ("'label3D'", "'_label3D_'", "'.json'", 7),
}


def _side_path(folder: str, infix: str, suffix: str) -> str:
    name = _STEM.replace("'_label_frontcenter_'", f"concat({infix}, 'frontcenter_')")
    return f"concat('a2d2/day', CAST(page_id % 9 AS STRING), '/', {folder}, '/cam_front_center/', {name}, {suffix})"


_LABEL_PATH = _side_path("'label'", "'_label_'", "'.png'")
_BUS_PATH = "concat('a2d2/day', CAST(page_id % 9 AS STRING), '/bus/2018', lpad(CAST(page_id AS STRING), 6, '0'), '_bus_signals.json')"


def _sql_text(expression: str) -> str:
    return expression.replace("STRING", "VARCHAR")


@query(
    "sidecar_match",
    _sql_text(
        f"SELECT page_id, 'front_center' AS sensor, "
        + ", ".join(
            f"CASE WHEN page_id % {m} <> 0 THEN {_side_path(a, b, c)} END AS {k}" for k, (a, b, c, m) in _SIDE.items()
        )
        + f", CASE WHEN page_id % 4 <> 0 THEN {_BUS_PATH} END AS bus FROM pages"
    ),
)
def sidecar_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    labels = pages.selectExpr("page_id", f"{_LABEL_PATH} AS path")
    wanted = [(_side_path(a, b, c), m) for a, b, c, m in _SIDE.values()] + [(_BUS_PATH, 4)]
    listing = pages.selectExpr(
        "explode(array(" + ", ".join(f"CASE WHEN page_id % {m} <> 0 THEN {p} END" for p, m in wanted) + ")) AS path"
    ).where("path IS NOT NULL")
    found = files.sidecars(labels, listing)
    return labels.join(found, labels.path == found.label).select(
        "page_id", "sensor", "image", "image_info", "lidar", "boxes", "bus"
    )
