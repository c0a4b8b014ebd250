"""What users add to requests and deliveries: own decoders, transforms and scenarios, batches, label upserts, label files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenelake import Catalog, SceneQuery
from scenelake.functions import taxonomy
from scenelake.operators import labels, upserts
from scenelake.plans.scenarios import SCENARIOS, Scenario, register_scenario
from scenelake.session import shared_dir
from scenelake.sources import payloads
from workload.labels import _NAMES_SQL, _name_maps
from workload.registry import query, table, view_sql
from workload.requests import scenes


@query(
    "request_decoded",
    "WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), "
    "lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents) "
    "SELECT doc_id AS lidar_uid, len(bytes) AS n_points, coalesce(list_sum(bytes), 0)::BIGINT AS label_sum FROM b",
)
def request_decoded(spark, sf_dir):
    """A request whose label payloads, one byte per point, go through the user's decoder."""
    docs = table(spark, sf_dir, "documents")
    sweeps = docs.select(
        F.col("doc_id").alias("lidar_uid"), F.coalesce("text", F.lit("")).cast("binary").alias("lidar_segmentation")
    )
    catalog = Catalog({"lidar_segmentation": sweeps}, {"lidar_segmentation": ["lidar_uid"]}, [])
    request = SceneQuery(catalog, {"lidar_segmentation": ["lidar_uid", "lidar_segmentation"]})
    own = {"lidar_segmentation": (payloads.flat_label_file, payloads.labels)}
    total = F.aggregate("lidar_segmentation", F.lit(0).cast("long"), lambda s, x: s + x)
    return request.decoded(own).select(
        "lidar_uid", F.size("lidar_segmentation").cast("long").alias("n_points"), total.alias("label_sum")
    )


def _discounted(frame):
    """A user's transform of one batch of rows."""
    return frame.assign(camera_id=frame["camera_id"].str.upper(), quarter=(frame["quantity"] // 4).astype("int64"))[
        ["camera_id", "weather_uid", "quarter"]
    ]


@query(
    "request_transform",
    view_sql("samples", "cameras") + "SELECT upper(camera_id) AS camera_id, c.weather_uid, floor(c.quantity / 4)::BIGINT AS quarter "
    "FROM cameras c JOIN samples s USING (weather_uid) WHERE s.split = 'validation'",
)
def request_transform(spark, sf_dir):
    """A user's function over Arrow batches of a request."""
    request = SceneQuery(
        scenes(spark, sf_dir), {"camera": ["camera_id", "weather_uid", "quantity"]}, splits=["validation"]
    )
    return request.map_batches(_discounted, "camera_id string, weather_uid bigint, quarter bigint")


@query(
    "user_scenario",
    view_sql("samples") + "SELECT weather_uid, location FROM samples WHERE tod IN ('Day', 'day', 'night') "
    "AND weather IN ('Fog', 'Overcast')",
)
def user_scenario(spark, sf_dir):
    """A scenario built from the user's own conditions by both operators and registered under its name."""
    dim = Scenario("grey", {"weather": ("Fog",)}) + Scenario("lid", {"weather": ("Overcast",)})
    lit = SCENARIOS["day"] + Scenario("dark", {"tod": ("night",)})
    own = register_scenario(lit * dim)
    try:
        return SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid", "location"]}, scenario=own.name).build()
    finally:
        SCENARIOS.pop(own.name)


@query(
    "batched_delivery",
    view_sql("samples") + ", n AS (SELECT weather_uid, row_number() OVER (ORDER BY time, weather_uid) - 1 AS i FROM samples "
    "WHERE split = 'testing') SELECT i // 100 AS batch, count(*) AS n_rows, arg_min(weather_uid, i) AS first_uid, "
    "arg_max(weather_uid, i) AS last_uid FROM n GROUP BY 1",
)
def batched_delivery(spark, sf_dir):
    """What a reader gets in batches of 100 rows; one partition at a time is in the driver's memory."""
    request = SceneQuery(scenes(spark, sf_dir), {"weather": ["weather_uid"]}, splits=["testing"], orderby="time")
    rows = [(i, len(b), b[0][0], b[-1][0]) for i, b in enumerate(request.batches(100))]
    return spark.createDataFrame(rows, "batch BIGINT, n_rows BIGINT, first_uid BIGINT, last_uid BIGINT")


@query(
    "upsert_labels",
    "WITH b AS (SELECT o_custkey AS camera_uid, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] "
    "ELSE [o_orderpriority] END AS boxes FROM orders), "
    "w AS (SELECT camera_uid, arg_max(boxes, seq) AS boxes FROM b WHERE boxes IS NOT NULL GROUP BY 1), "
    "s AS (SELECT c_custkey AS camera_uid, [c_mktsegment] AS boxes FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT camera_uid, len(coalesce(w.boxes, s.boxes))::BIGINT AS n_boxes, coalesce(w.boxes, s.boxes)[1] AS first_label "
    "FROM s FULL JOIN w USING (camera_uid)",
)
def upsert_labels(spark, sf_dir):
    """Stored label lists and a batch that lacks some, empties some and replaces some: the last given list counts."""
    stored = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    stored = stored.select(F.col("c_custkey").alias("camera_uid"), F.array("c_mktsegment").alias("boxes"))
    kind = F.col("o_orderkey") % 3
    boxes = F.when(kind == 1, F.array().cast("array<string>")).when(kind == 2, F.array("o_orderpriority"))
    batch = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("camera_uid"), boxes.alias("boxes"), F.col("o_orderkey").alias("seq")
    )
    merged = upserts.upsert_labels(stored, batch, "camera_uid", "boxes", "seq")
    return merged.select(
        "camera_uid", F.size("boxes").cast("long").alias("n_boxes"), F.get("boxes", 0).alias("first_label")
    )


@query(
    "label_file",
    f"WITH names AS (SELECT name, split_part(name, ' ', 1) AS category FROM ({_NAMES_SQL} UNION SELECT 'void')), "
    "cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS cat_id FROM (SELECT DISTINCT category FROM names)) "
    "SELECT name, row_number() OVER (ORDER BY name <> 'void', category, name) - 1 AS id, category, cat_id "
    "FROM names JOIN cats USING (category)",
)
def label_file(spark, sf_dir):
    """The label dimension written as a file of records and read again."""
    path = f"{shared_dir(spark)}/labels/{uuid.uuid4().hex}"
    names = labels.number_labels(labels.union_names(_name_maps(spark, sf_dir)), taxonomy.first_word(F.col("name")))
    labels.write_label_dim(names, path)
    rows = spark.read.schema(labels.LABEL_DIM).json(path)
    return rows.select("name", F.col("id").cast("long").alias("id"), "category", F.col("cat_id").cast("long").alias("cat_id"))
