"""Batches into the versioned store: samples, cameras with payloads and labels, one commit each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenelake.session import shared_dir
from scenelake.sources.store import SceneStore
from scenelake.streaming import ingest
from workload.registry import VIEWS, query, table


def _root(spark) -> str:
    return f"{shared_dir(spark)}/store/{uuid.uuid4().hex}"


# An event is a sample and a frame of one of three cameras; its properties stand for the image.
_FRAME = {
    **VIEWS["frames"][2],
    "seq": "event_id",
    "weather": "event_type",
    "camera_id": "concat('cam_', user_id % 3)",
    "props": "props",
    "value": "value",
}


def _frames(df):
    rows = df.selectExpr(*[f"{e} AS {c}" for c, e in _FRAME.items()])
    fixed = {"tod": "Day", "dataset": "events", "split": "training"}
    return rows.withColumn("time", F.col("time").cast("timestamp")).withColumns({c: F.lit(v) for c, v in fixed.items()})


def _cameras(rows, image, labelled, label):
    box = F.array(F.struct(F.col("value").alias("x"), label.alias("label")))
    return rows.select(
        "time", "location", "camera_id", "seq", image.cast("binary").alias("image"), F.when(labelled, box).alias("camera_box")
    )


_FRAMES_SQL = "WITH f AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _FRAME.items()) + " FROM events)"


@query(
    "store_batches",
    _FRAMES_SQL + """,
a AS (SELECT * FROM f WHERE seq % 4 <> 1), b AS (SELECT * FROM f WHERE seq % 3 = 0 OR seq % 4 = 1),
images AS (SELECT time, location, camera_id, arg_max(image, o) AS image FROM
    (SELECT time, location, camera_id, props AS image, seq AS o FROM a UNION ALL
     SELECT time, location, camera_id, upper(props), seq + 1000000000000 FROM b) GROUP BY ALL),
boxes AS (SELECT time, location, camera_id, arg_max(label, o) AS label FROM
    (SELECT time, location, camera_id, weather AS label, seq AS o FROM a WHERE seq % 2 = 0 UNION ALL
     SELECT time, location, camera_id, 'again', seq + 1000000000000 FROM b WHERE seq % 5 = 0) GROUP BY ALL),
samples AS (SELECT time, location, arg_min(weather, o) AS weather FROM
    (SELECT time, location, weather, seq AS o FROM a UNION ALL
     SELECT time, location, weather, seq + 1000000000000 FROM b) GROUP BY ALL)
SELECT location, epoch_us(time) AS at, camera_id, weather, md5(image) AS image_md5, label
FROM images JOIN samples USING (time, location) LEFT JOIN boxes USING (time, location, camera_id)""",
)
def store_batches(spark, sf_dir):
    """Two overlapping batches; the second changes images and some labels of what the first stored."""
    store = SceneStore.create(spark, _root(spark))
    frames = _frames(table(spark, sf_dir, "events"))
    a, b = frames.where("seq % 4 <> 1"), frames.where("seq % 3 = 0 OR seq % 4 = 1")
    first = _cameras(a, F.col("props"), F.col("seq") % 2 == 0, F.col("weather"))
    second = _cameras(b, F.upper("props"), F.col("seq") % 5 == 0, F.lit("again"))
    sample = ["time", "location", "weather", "tod", "dataset", "split", "custom", "seq"]
    store.store_batch(0, {"weather": a.select(*sample), "camera": first})
    store.store_batch(1, {"weather": b.select(*sample), "camera": second})
    rows = store.table("camera", ["image"]).join(store.table("weather"), "weather_uid")
    rows = rows.join(store.table("camera_box"), "camera_uid", "left")
    return rows.select(
        "location",
        F.unix_micros("time").alias("at"),
        "camera_id",
        "weather",
        F.md5("image").alias("image_md5"),
        F.get("camera_box", 0)["label"].alias("label"),
    )


@query(
    "stream_store",
    _FRAMES_SQL + """ SELECT location, epoch_us(time) AS at, arg_min(weather, seq) AS weather, min(seq) AS first_seq
FROM f GROUP BY location, time""",
)
def stream_store(spark, sf_dir):
    """Event files as a stream of batches; each becomes one commit under its batch number."""
    root = _root(spark)
    store = SceneStore.create(spark, root)
    raw = ingest.watch(spark, table(spark, sf_dir, "events").schema, sf_dir, pattern="events.parquet")
    samples = _frames(raw).withColumn("custom", F.col("seq").cast("string"))

    def merge(batch, batch_id):
        SceneStore(batch.sparkSession, root).store_batch(batch_id, {"weather": batch})

    ingest.into_batches(samples, merge, f"{root}/checkpoint", once=True).awaitTermination()
    return store.table("weather").select(
        "location", F.unix_micros("time").alias("at"), "weather", F.col("custom").cast("long").alias("first_seq")
    )
