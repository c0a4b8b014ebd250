"""Paths, timestamps, JSON fields and frame flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake.functions import paths
from scenelake.operators.labeling import micros
from scenelake.sources import frames
from workload.registry import query, table

_SPLITS = ["training", "validation", "testing", "none"]


@query(
    "path_context",
    "SELECT page_id, split_part(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1), '.', 1) AS context, "
    "CASE page_id % 4 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' WHEN 2 THEN 'testing' ELSE '' END AS split FROM pages",
)
def path_context(spark, sf_dir):
    plain = F.regexp_replace("url", r"[?#].*$", "")
    folder = F.get(F.lit(_SPLITS), F.pmod("page_id", F.lit(4)).cast("int"))
    path = F.concat_ws("/", F.lit("waymo"), folder, F.lit("lidar"), plain)
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.context_name(path).alias("context"), paths.split_of(path).alias("split")
    )


@query(
    "path_rewrite",
    """WITH p AS (SELECT page_id, '2018' || lpad(page_id::VARCHAR, 6, '0') AS t, 'seq' || (page_id % 7) AS s,
        lpad(page_id::VARCHAR, 9, '0') AS n FROM pages)
    SELECT page_id, './a2d2/' || s || '/camera/cam_front_center/' || t || '_camera_frontcenter_' || n || '.png' AS image,
        './a2d2/' || s || '/label3D/cam_front_center/' || t || '_label3D_frontcenter_' || n || '.json' AS boxes,
        './a2d2/' || s || '/bus/' || t || '_bus_signals.json' AS bus,
        './a2d2/' || s || '/camera/cam_front_center/' || t || '_camera_frontcenter_' || n || '.json' AS info FROM p""",
)
def path_rewrite(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "concat('./a2d2/seq', page_id % 7, '/lidar/cam_front_center/2018', lpad(CAST(page_id AS STRING), 6, '0'), "
        "'_lidar_frontcenter_', lpad(CAST(page_id AS STRING), 9, '0'), '.npz') AS lidar",
    )
    image = paths.image_of_lidar(F.col("lidar"))
    return pages.select(
        "page_id",
        image.alias("image"),
        paths.boxes_of_image(image).alias("boxes"),
        paths.bus_of_lidar(F.col("lidar")).alias("bus"),
        paths.info_of_image(image).alias("info"),
    )


@query(
    "micros_ts",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM events",
)
def micros_ts(spark, sf_dir):
    at = F.timestamp_micros("us")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", micros("ts").alias("us"))
        .select(
            "event_id",
            F.to_date(at).cast("string").alias("day"),
            F.hour(at).cast("long").alias("hour"),
            F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"),
        )
    )


@query("json_field", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query(
    "json_encode",
    "SELECT event_id, '{\"type\":\"' || event_type || '\",\"k\":' || (props->>'k') || '}' AS parameters FROM events",
)
def json_encode(spark, sf_dir):
    body = F.struct(F.col("event_type").alias("type"), F.from_json("props", "k BIGINT")["k"].alias("k"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(body).alias("parameters"))


# -- frames -----------------------------------------------------------------

_LABELS = {"void": 0, "car": 1, "truck": 2, "bus": 3, "vehicle": 4, "ego vehicle": 5}


def _frames(spark, sf_dir):
    """One decoded frame per vector: two cameras, boxes for camera 1 only, no lasers."""
    e = lambda i: F.get("embedding", i).cast("double")
    row = lambda *v: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in v])
    pose = row(0.0, -1.0, 0.0, e(1), 1.0, 0.0, 0.0, e(2), 0.0, 0.0, 1.0, e(3), 0.0, 0.0, 0.0, 1.0)
    box = lambda i, kind: F.struct(
        e(i).alias("x"), e(i + 1).alias("y"), e(i + 2).alias("length"), e(i + 3).alias("width"), F.lit(kind).alias("type")
    )
    image = lambda name: F.struct(
        F.lit(name).alias("name"),
        F.lit(b"").alias("image"),
        F.struct(
            F.lit(2).alias("height"),
            F.lit(2).alias("width"),
            F.transform(F.slice("embedding", name, 4), lambda x: F.floor(F.abs(x) * 100).cast("int") % 6).alias("labels"),
        ).alias("semantic"),
    )
    mount = lambda name: F.struct(
        F.lit(name).alias("name"),
        row(e(4), 0.0, e(5), 0.0, e(6), e(7), 0.0, 0.0, 1.0).alias("intrinsic"),
        pose.alias("extrinsic"),
        F.lit(1920).alias("width"),
        F.lit(1280).alias("height"),
    )
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("vec_id").alias("timestamp_micros"),
        F.concat(F.lit("location_"), "label").alias("location"),
        F.lit("sunny").alias("weather"),
        F.lit("Day").alias("time_of_day"),
        pose.alias("pose"),
        F.array(image(1), image(2)).alias("images"),
        F.array(
            F.struct(F.lit(1).alias("name"), F.array(box(10, "TYPE_VEHICLE"), box(20, "TYPE_SIGN")).alias("labels"))
        ).alias("camera_labels"),
        F.array(mount(1), mount(2)).alias("camera_calibrations"),
    )


@query(
    "explode_frames",
    """WITH f AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e, unnest([1, 2]) AS cam FROM embeddings)
    SELECT 'location_' || label AS location, 'waymo_' || cam AS camera_id, round(e[5], 6) + 0.0 AS fx,
        round(e[2], 6) + 0.0 AS tx, CASE cam WHEN 1 THEN 2 ELSE 0 END AS n_boxes,
        CASE cam WHEN 1 THEN 'vehicle,traffic sign' ELSE '' END AS box_labels,
        list_sum([CAST(floor(abs(e[cam + i]::FLOAT) * 100) AS BIGINT) % 6 FOR i IN range(0, 4)])::BIGINT AS label_sum,
        round(sqrt(0.5), 6) AS qw FROM f""",
)
def explode_frames(spark, sf_dir):
    names = {n: i for i, n in enumerate(["void", "ego vehicle", "car", "truck", "bus", "vehicle"])}
    rest = {n: 100 for n in ("bicycle", "motorcycle", "person", "rider", "bird", "animal", "pole", "traffic sign",
                             "traffic light", "building", "road", "lane marking", "sidewalk", "vegetation", "sky",
                             "ground", "dynamic", "static")}
    rows = frames.image_rows(_frames(spark, sf_dir), rest | names)
    total = F.aggregate("camera_segmentation.labels", F.lit(0).cast("long"), lambda acc, x: acc + x)
    parameters = F.col("camera_parameters")
    return rows.select(
        "location",
        "camera_id",
        (F.round(parameters["intrinsic"][0][0], 6) + 0.0).alias("fx"),
        (F.round(parameters["translation"][0], 6) + 0.0).alias("tx"),
        F.size("camera_box").cast("long").alias("n_boxes"),
        F.array_join(F.transform("camera_box", lambda b: b["label"]), ",").alias("box_labels"),
        total.alias("label_sum"),
        F.round(F.abs(parameters["rotation"][0]), 6).alias("qw"),
    )
