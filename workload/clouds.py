"""Point cloud operators; every vector is a cloud of 21 points from its elements 1 to 63."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake.functions.taxonomy import WAYMO_LIDAR
from scenelake.operators import clouds, geometry, pyramid
from scenelake.sources import frames
from workload.labels import _RASTER_SQL
from workload.registry import query, rounded, table

# Spark and SQL both count the elements from the same list; points are in tenths of a metre.
POINTS_SQL = """points AS (SELECT vec_id, label, i AS pt_idx, embedding[2 + 3*i]::DOUBLE AS x,
    embedding[3 + 3*i]::DOUBLE AS y, embedding[4 + 3*i]::DOUBLE AS z
    FROM embeddings, range(0, 21) r(i))"""


def sweeps(spark, sf_dir):
    """(vec_id, label, embedding, points)."""
    element = lambda i: F.get("embedding", i)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda i: F.struct(*[element(i * 3 + (k + 1)).alias(a) for k, a in enumerate("xyz")]),
    )
    return table(spark, sf_dir, "embeddings").withColumn("points", points)


def point_rows(spark, sf_dir, *keep):
    return geometry.explode_points(sweeps(spark, sf_dir), "vec_id", *keep)


_BOXES_SQL = """boxes AS (SELECT vec_id, k AS box_idx, embedding[2 + 15*k]::DOUBLE AS x, embedding[3 + 15*k]::DOUBLE AS y,
    embedding[4 + 15*k]::DOUBLE AS z, 0.1 + 0.1*k AS length, 0.05 + 0.12*k AS width, 0.2 + 0.1*k AS height,
    0.3 * label - 1.0 AS yaw FROM embeddings, range(0, 4) r(k))"""


def box_rows(spark, sf_dir):
    """Four boxes per cloud, centered on points 0, 5, 10 and 15 and turned by the label."""
    number = lambda base, step: F.lit(base) + F.col("box_idx") * step
    at = lambda offset: F.get("embedding", (F.col("box_idx") * 15 + offset).cast("int")).cast("double")
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("box_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .select(
            "vec_id",
            F.col("box_idx").cast("long").alias("box_idx"),
            at(1).alias("x"),
            at(2).alias("y"),
            at(3).alias("z"),
            number(0.1, 0.1).alias("length"),
            number(0.05, 0.12).alias("width"),
            number(0.2, 0.1).alias("height"),
            (F.col("label") * 0.3 - 1.0).alias("yaw"),
        )
    )


_INSIDE = """abs(cos(b.yaw)*(p.x-b.x) + sin(b.yaw)*(p.y-b.y)) <= b.length/2
    AND abs(cos(b.yaw)*(p.y-b.y) - sin(b.yaw)*(p.x-b.x)) <= b.width/2 AND abs(p.z-b.z) <= b.height/2"""


@query(
    "points_in_box",
    f"WITH {POINTS_SQL}, {_BOXES_SQL} SELECT b.vec_id, b.box_idx, count(*) AS points_in_box FROM boxes b "
    f"JOIN points p ON p.vec_id = b.vec_id AND {_INSIDE} GROUP BY ALL",
)
def points_in_box(spark, sf_dir):
    return pyramid.points_in_boxes(point_rows(spark, sf_dir), box_rows(spark, sf_dir), "vec_id")


@query(
    "explode_sweeps",
    f"WITH {POINTS_SQL}, {_BOXES_SQL}, held AS (SELECT b.vec_id, b.box_idx, count(*) AS n FROM boxes b "
    f"JOIN points p ON p.vec_id = b.vec_id AND {_INSIDE} GROUP BY ALL) "
    "SELECT e.vec_id, 'waymo_1' AS lidar_id, 21::BIGINT AS n_points, count(h.box_idx) AS n_boxes, "
    "coalesce(sum(h.n), 0)::BIGINT AS n_inside, round(any_value(e.embedding[2]::DOUBLE), 5) + 0.0 AS first_x "
    "FROM embeddings e LEFT JOIN held h USING (vec_id) GROUP BY e.vec_id",
)
def explode_sweeps(spark, sf_dir):
    """Frames with one laser and the four boxes of its cloud, flattened to a sweep with counted boxes."""
    number = lambda v: F.lit(float(v))
    eye = F.array(*[number(i % 5 == 0) for i in range(16)])
    at = lambda i: F.get("embedding", i).cast("double")
    boxes = [
        F.struct(
            *[at(15 * k + 1 + i).alias(a) for i, a in enumerate("xyz")],
            *[number(v).alias(a) for a, v in (("length", 0.1 + 0.1 * k), ("width", 0.05 + 0.12 * k), ("height", 0.2 + 0.1 * k))],
            (F.col("label") * 0.3 - 1.0).alias("yaw"),
            F.lit("TYPE_VEHICLE").alias("type"),
        )
        for k in range(4)
    ]
    laser = F.struct(
        F.lit(1).alias("name"),
        "points",
        F.transform("points", lambda p: F.array(number(0), number(0), number(0))).alias("features"),
        F.transform("points", lambda p: number(1)).alias("ranges"),
        F.transform("points", lambda p: F.lit(0)).alias("labels"),
    )
    decoded = sweeps(spark, sf_dir).select(
        F.col("vec_id").alias("timestamp_micros"),
        F.lit("location_sf").alias("location"),
        eye.alias("pose"),
        F.array(*boxes).alias("laser_labels"),
        F.array(F.struct(F.lit(1).alias("name"), eye.alias("extrinsic"))).alias("laser_calibrations"),
        F.array(laser).alias("lasers"),
    )
    rows = frames.lidar_rows(decoded, {unified: i for i, (_, unified) in enumerate(WAYMO_LIDAR)})
    total = F.aggregate("lidar_box", F.lit(0).cast("long"), lambda acc, b: acc + b["points_in_box"])
    return rows.select(
        F.unix_micros("time").alias("vec_id"),
        "lidar_id",
        F.size("points").cast("long").alias("n_points"),
        F.size("lidar_box").cast("long").alias("n_boxes"),
        total.alias("n_inside"),
        (F.round(F.col("points")[0]["x"].cast("double"), 5) + 0.0).alias("first_x"),
    )


@query(
    "points_in_box_by_label",
    f"WITH {POINTS_SQL}, {_BOXES_SQL.replace('0.1 + 0.1*k', '0.5 + 3.0*k').replace('0.05 + 0.12*k', '0.4 + 2.0*k')} "
    "SELECT b.vec_id, b.box_idx, count(*) AS points_in_box FROM "
    "(SELECT boxes.*, e.label FROM boxes JOIN embeddings e USING (vec_id)) b "
    f"JOIN points p ON p.label = b.label AND {_INSIDE} GROUP BY ALL",
)
def points_in_box_by_label(spark, sf_dir):
    """Few large clouds: all points of a label form one sweep, its vectors' boxes lie in it."""
    points = point_rows(spark, sf_dir, "label")
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    boxes = box_rows(spark, sf_dir).join(labels, "vec_id").withColumns(
        {"length": F.lit(0.5) + F.col("box_idx") * 3.0, "width": F.lit(0.4) + F.col("box_idx") * 2.0}
    )
    # Box numbers are unique within a sweep.
    boxes = boxes.withColumn("box_idx", F.col("vec_id") * 4 + F.col("box_idx"))
    counts = pyramid.points_in_boxes(points, boxes, "label")
    return counts.select(
        F.floor(F.col("box_idx") / 4).cast("long").alias("vec_id"), (F.col("box_idx") % 4).alias("box_idx"), "points_in_box"
    )


@query(
    "points_in_aabb",
    f"WITH {POINTS_SQL} SELECT count(*) AS n_points FROM points WHERE abs(x) <= 0.1 AND abs(y) <= 0.15 AND abs(z) <= 0.05",
)
def points_in_aabb(spark, sf_dir):
    return clouds.points_in_origin_box(point_rows(spark, sf_dir), width=0.2, length=0.3, height=0.1)


@query(
    "range_mask",
    "WITH e AS (SELECT vec_id, label, embedding[1:32] AS ranges, [floor(abs(x::DOUBLE) * 100)::BIGINT FOR x IN embedding[33:64]] AS ids "
    "FROM embeddings), k AS (SELECT vec_id, [ids[i] FOR i IN range(1, 33) IF ranges[i] > 0] AS kept FROM e WHERE label <> 3) "
    "SELECT vec_id, generate_subscripts(kept, 1) - 1 AS pos, unnest(kept) AS label FROM k",
)
def range_mask(spark, sf_dir):
    """Label 3 stands for a sensor without labels, which yields nothing."""
    ids = F.transform(F.slice("embedding", 33, 32), lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int"))
    labels = F.when(F.col("label") != 3, ids)
    kept = clouds.valid_returns(F.slice("embedding", 1, 32), labels)
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode(kept).alias("pos", "label"))
        .select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label"))
    )


@query(
    "usable_sweeps",
    "SELECT vec_id FROM embeddings WHERE list_max([abs(x::DOUBLE) FOR x IN embedding]) >= 0.35 OR label IN (0, 4)",
)
def usable_sweeps(spark, sf_dir):
    """Labels are nonzero for strong elements; labels 0 and 4 come from frames with boxes, one list empty."""
    segmentation = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) >= 0.35, 1).otherwise(0))
    boxes = F.when(F.col("label") == 0, F.array()).when(F.col("label") == 4, F.array(F.lit("box")))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", segmentation.alias("lidar_segmentation"), boxes.alias("lidar_box")
    )
    return clouds.usable_sweeps(rows).select("vec_id")


@query(
    "concat_points",
    f"WITH {POINTS_SQL} SELECT vec_id, CASE WHEN pt_idx < 10 THEN 'front' ELSE 'top' END AS lidar_id, "
    "CASE WHEN pt_idx < 10 THEN pt_idx ELSE pt_idx - 10 END AS pt_idx, round(x, 5) + 0.0 AS x FROM points",
)
def concat_points(spark, sf_dir):
    base = sweeps(spark, sf_dir)
    front = base.select("vec_id", F.lit("front").alias("lidar_id"), F.slice("points", 1, 10).alias("points"))
    top = base.select("vec_id", F.lit("top").alias("lidar_id"), F.slice("points", 11, 11).alias("points"))
    rows = clouds.concat_sensors(front.unionAll(top), ["vec_id"], "lidar_id")
    return rows.select(
        "vec_id", "lidar_id", F.col("pt_idx").cast("long").alias("pt_idx"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x")
    )


@query(
    "slice_points",
    "SELECT vec_id, i AS row, round(embedding[6*i + 1]::DOUBLE, 5) + 0.0 AS range, round(embedding[6*i + 3]::DOUBLE, 5) + 0.0 AS elongation, "
    "round(embedding[6*i + 4]::DOUBLE, 5) + 0.0 AS x, round(embedding[6*i + 6]::DOUBLE, 5) + 0.0 AS z FROM embeddings, range(0, 10) r(i)",
)
def slice_points(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.slice("embedding", i * 6 + 1, F.lit(6)))
    parts = table(spark, sf_dir, "embeddings").select("vec_id", clouds.split_features(rows).alias("s"))
    both = F.arrays_zip(F.col("s.features").alias("f"), F.col("s.points").alias("p"))
    value = lambda c: F.round(c.cast("double"), 5) + 0.0
    return parts.select("vec_id", F.posexplode(both).alias("row", "r")).select(
        "vec_id",
        F.col("row").cast("long").alias("row"),
        value(F.col("r.f")[0]).alias("range"),
        value(F.col("r.f")[2]).alias("elongation"),
        value(F.col("r.p.x")).alias("x"),
        value(F.col("r.p.z")).alias("z"),
    )


@query(
    "prob_quantize",
    "SELECT vec_id, i - 1 AS pos, floor(abs(embedding[i]::DOUBLE) * 255)::BIGINT AS q FROM embeddings, range(1, 65) r(i)",
)
def prob_quantize(spark, sf_dir):
    q = clouds.quantize(F.transform("embedding", F.abs))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(q).alias("pos", "q"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("q").cast("long").alias("q"))


@query(
    "prob_normalize",
    "WITH p AS (SELECT vec_id, c, i, abs(embedding[16*c + i]::DOUBLE) AS v FROM embeddings, range(0, 4) a(c), range(1, 17) b(i)) "
    "SELECT vec_id, c AS class, i - 1 AS pixel, round(v / sum(v) OVER (PARTITION BY vec_id, i), 6) AS p FROM p",
)
def prob_normalize(spark, sf_dir):
    """64 elements as 4 classes by 16 pixels."""
    scores = F.array(*[F.transform(F.slice("embedding", 16 * c + 1, 16), F.abs) for c in range(4)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", clouds.normalize_classes(scores).alias("p"))
    by_class = rows.select("vec_id", F.posexplode("p").alias("class", "row"))
    return by_class.select("vec_id", "class", F.posexplode("row").alias("pixel", "p")).select(
        "vec_id",
        F.col("class").cast("long").alias("class"),
        F.col("pixel").cast("long").alias("pixel"),
        F.round("p", 6).alias("p"),
    )


def _fps_sql(n: int) -> str:
    """Farthest points one round at a time: the next is the lowest index at the largest distance."""
    step = "((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))"
    parts = [POINTS_SQL, "s0 AS (SELECT vec_id, 0 AS pick FROM points GROUP BY vec_id)"]
    parts.append(
        f"d0 AS (SELECT p.*, {step} AS d FROM points p JOIN s0 USING (vec_id) "
        "JOIN points q ON q.vec_id = p.vec_id AND q.pt_idx = s0.pick)"
    )
    for k in range(1, n):
        parts.append(f"s{k} AS (SELECT vec_id, arg_max(pt_idx, (d, -pt_idx)) AS pick FROM d{k-1} GROUP BY vec_id)")
        parts.append(
            f"d{k} AS (SELECT p.* EXCLUDE (d), least(p.d, {step}) AS d FROM d{k-1} p JOIN s{k} USING (vec_id) "
            f"JOIN points q ON q.vec_id = p.vec_id AND q.pt_idx = s{k}.pick)"
        )
    picks = " UNION ALL ".join(f"SELECT vec_id, pick::BIGINT AS pt_idx FROM s{k}" for k in range(n))
    return "WITH " + ", ".join(parts) + f", picks AS ({picks}) "


@query("fps", _fps_sql(6) + "SELECT vec_id, pt_idx FROM picks")
def fps(spark, sf_dir):
    picks = clouds.farthest_points(sweeps(spark, sf_dir), 6, keep=["vec_id"])
    return picks.select("vec_id", F.explode(F.col("picked").cast("array<bigint>")).alias("pt_idx"))


@query(
    "downsample",
    _fps_sql(4)
    + f"SELECT k.vec_id, sum(raster[k.pt_idx + 1])::BIGINT AS label_sum, {rounded('sum(q.x)', 5)} AS x_sum "
    "FROM picks k JOIN points q ON q.vec_id = k.vec_id AND q.pt_idx = k.pt_idx "
    f"JOIN (SELECT vec_id, {_RASTER_SQL} AS raster FROM embeddings) r ON r.vec_id = k.vec_id GROUP BY k.vec_id",
)
def downsample(spark, sf_dir):
    """Points and their labels, shrunk together."""
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 400).cast("int") % 23)
    labelled = sweeps(spark, sf_dir).select("vec_id", "points", F.slice(ids, 1, 21).alias("labels"))
    small = clouds.downsample(labelled, 4, ["labels"])
    add = lambda acc, x: acc + x
    return small.select(
        "vec_id",
        F.aggregate("labels_downsampled", F.lit(0).cast("long"), add).alias("label_sum"),
        (
            F.round(F.aggregate("points_downsampled", F.lit(0.0), lambda acc, p: acc + p["x"].cast("double")), 5) + 0.0
        ).alias("x_sum"),
    )


_DRAW = "(instr('0123456789abcdef', substr(md5('7|' || vec_id), 1, 1)) - 1) % 4"


@query(
    "flip_points",
    f"WITH {POINTS_SQL} SELECT vec_id, pt_idx, round(CASE WHEN {_DRAW} IN (1, 3) THEN -x ELSE x END, 5) + 0.0 AS x, "
    f"round(CASE WHEN {_DRAW} IN (2, 3) THEN -y ELSE y END, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM points",
)
def flip_points(spark, sf_dir):
    return _flipped(spark, sf_dir).select(
        "vec_id", F.col("pt_idx").cast("long").alias("pt_idx"), *[(F.round(a, 5) + 0.0).alias(a) for a in "xyz"]
    )


def _flipped(spark, sf_dir):
    flipped = sweeps(spark, sf_dir).withColumn("points", clouds.flip(F.col("points"), F.col("vec_id"), seed=7))
    return geometry.explode_points(flipped, "vec_id")


@query(
    "flip_magnitudes",
    f"WITH {POINTS_SQL} SELECT vec_id, pt_idx, round(abs(x), 5) AS x, round(abs(y), 5) AS y, round(z, 5) + 0.0 AS z FROM points",
)
def flip_magnitudes(spark, sf_dir):
    """What a flip must leave alone."""
    flipped = _flipped(spark, sf_dir)
    return flipped.select(
        "vec_id",
        F.col("pt_idx").cast("long").alias("pt_idx"),
        F.round(F.abs("x"), 5).alias("x"),
        F.round(F.abs("y"), 5).alias("y"),
        (F.round("z", 5) + 0.0).alias("z"),
    )
