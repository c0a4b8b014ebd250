"""Streaming ingest, de-duplication and label propagation over the event files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenelake.operators import upserts
from scenelake.session import shared_dir
from scenelake.streaming import ingest, labels
from workload.registry import VIEWS, query, table, view_sql


def _stream(spark, sf_dir, name):
    base, where, columns = VIEWS[name]
    schema = table(spark, sf_dir, base).schema
    raw = ingest.watch(spark, schema, sf_dir, pattern=f"{base}.parquet")
    rows = raw.where(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return rows.withColumn("time", F.col("time").cast("timestamp"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _drain(spark, stream):
    """Run the stream over what is there and read its output back."""
    folder = _folder(spark)
    ingest.append_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "stream_first_wins",
    view_sql("frames") + "SELECT location, strftime(date_trunc('hour', time), '%Y-%m-%d %H') AS hour FROM frames GROUP BY 1, 2",
)
def stream_first_wins(spark, sf_dir):
    """One row per place and hour; the hour stands for the sample time, so duplicates abound."""
    frames = _stream(spark, sf_dir, "frames").select("location", F.date_trunc("hour", "time").alias("time"))
    kept = _drain(spark, ingest.first_per_sample(frames, delay="2 hours"))
    return kept.select("location", F.date_format("time", "yyyy-MM-dd HH").alias("hour"))


@query(
    "stream_propagate",
    view_sql("frames", "label_events") + """SELECT f.weather_uid, e.seq, e.label FROM label_events e JOIN frames f
    ON e.location = f.location AND f.time >= e.time AND f.time <= e.time + INTERVAL 600 SECONDS""",
)
def stream_propagate(spark, sf_dir):
    frames = _stream(spark, sf_dir, "frames").select("weather_uid", "location", "time")
    events = _stream(spark, sf_dir, "label_events").select("seq", "label", "location", "time")
    covered = labels.propagate(frames, events, delay="1 hour", seconds=600)
    return _drain(spark, covered).select("weather_uid", "seq", "label")


@query(
    "stream_winner",
    view_sql("frames", "label_events") + """SELECT f.weather_uid, arg_max(e.label, e.seq) AS label FROM label_events e
    JOIN frames f ON e.location = f.location AND f.time >= e.time AND f.time <= e.time + INTERVAL 600 SECONDS
    GROUP BY f.weather_uid""",
)
def stream_winner(spark, sf_dir):
    """One label per frame, kept as state until the watermark passes. A closing row, a day after the last event, ends the stream."""
    end = table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("time"))
    folder = _folder(spark)
    shape = "location STRING, time TIMESTAMP, weather_uid BIGINT, seq BIGINT, label STRING"
    nothing = {c: F.lit(None).cast(k) for c, k in (("location", "string"), ("weather_uid", "bigint"), ("seq", "bigint"), ("label", "string"))}
    end.withColumns(nothing).write.parquet(f"{folder}/end")
    absent = lambda kind: F.lit(None).cast(kind)
    frames = _stream(spark, sf_dir, "frames").select(
        "location", "time", "weather_uid", absent("bigint").alias("seq"), absent("string").alias("label")
    )
    events = _stream(spark, sf_dir, "label_events").select("location", "time", absent("bigint").alias("weather_uid"), "seq", "label")
    rows = frames.union(events).union(ingest.watch(spark, shape, f"{folder}/end").select(*frames.columns))
    name, value = labels.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        won = _drain(spark, labels.propagate_winners(rows, delay="1 hour", seconds=600))
    finally:
        spark.conf.set(name, before)
    return won.select("weather_uid", "label")


@query(
    "stream_ingest",
    view_sql("samples") + """SELECT location, time_key, min(weather_uid) AS first_uid FROM
    (SELECT *, strftime(time, '%Y-%m-%d') AS time_key FROM samples) GROUP BY location, time_key""",
)
def stream_ingest(spark, sf_dir):
    """Order files as sample batches; each batch inserts the samples that are not stored yet."""
    folder = _folder(spark)
    seen = []
    schema = "weather_uid BIGINT, location STRING, time TIMESTAMP, first_uid BIGINT"

    def merge(batch, batch_id):
        rows = batch.select("location", "time", F.col("weather_uid").alias("first_uid"), F.col("weather_uid").alias("seq"))
        stored = ingest.version_of(batch.sparkSession, folder, schema, batch_id)
        merged = upserts.insert_first(stored, rows, ["time", "location"], "seq", "weather_uid")
        ingest.write_version(merged, folder, batch_id)
        seen.append(batch_id)

    samples = _stream(spark, sf_dir, "samples").select("weather_uid", "location", "time")
    ingest.into_batches(samples, merge, f"{folder}/checkpoint", once=True).awaitTermination()
    final = ingest.version_of(spark, folder, schema, max(seen) + 1)
    return final.select("location", F.date_format("time", "yyyy-MM-dd").alias("time_key"), "first_uid")
