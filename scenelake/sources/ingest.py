"""Storing a flattened batch: samples first, then sensors, then their labels.

A merge reads and rewrites only the storage partitions its batch falls into,
and is committed before the next step reads its keys. All merges are keyed, so
a repeated batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake import schemas
from scenelake.operators.lookup import require
from scenelake.operators.upserts import insert_first, next_uid, upsert_labels, upsert_last
from scenelake.session import shared_dir
from scenelake.sources.tables import overwrite_touched, touched

SENSOR_VALUES = {
    "camera": ("image", "camera_parameters", "camera_vehicle_pose"),
    "lidar": ("points", "features", "lidar_parameters", "lidar_vehicle_pose"),
}
LABEL_TABLES = {
    "camera": ("camera_segmentation", "camera_box"),
    "lidar": ("lidar_segmentation", "lidar_box"),
}


def _cast(df: DataFrame, table: str) -> DataFrame:
    """Bring nested columns to the stored types, by field name."""
    fields = schemas.table_schema(table).fields
    return df.select(*[shaped(F.col(f.name), df.schema[f.name].dataType, f.dataType).alias(f.name) for f in fields])


def shaped(column, have, want):
    if have == want:
        return column
    kind = want.typeName()
    if kind == "struct" and have.typeName() == "struct":
        parts = []
        for f in want.fields:
            inner = shaped(column[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)
            parts.append(inner.alias(f.name))
        return F.when(column.isNotNull(), F.struct(*parts))
    if kind == "array" and have.typeName() == "array":
        return F.transform(column, lambda x: shaped(x, have.elementType, want.elementType))
    return column.cast(want)


def _typed(rows: DataFrame, sensor: str, key: list[str]) -> DataFrame:
    """A sensor batch's key, order and stored columns, brought to the stored types."""
    wanted = {f.name: f.dataType for t in (sensor, *LABEL_TABLES[sensor]) for f in schemas.table_schema(t).fields}
    kept = [c for c in (*SENSOR_VALUES[sensor], *LABEL_TABLES[sensor]) if c in rows.columns]
    return rows.select(*key, "seq", *[shaped(F.col(c), rows.schema[c].dataType, wanted[c]).alias(c) for c in kept])


def _staged(df: DataFrame, root: str | None) -> DataFrame:
    """Write a batch once; its merge and its label merges then read it instead of flattening again."""
    place = f"{(root or shared_dir(df.sparkSession)).rstrip('/')}/_staged/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def store_batch(
    spark: SparkSession, batch: Mapping[str, DataFrame], database: str | None = None, root: str | None = None
) -> dict[str, DataFrame]:
    """Merge a batch into the scene tables and return them.

    ``weather`` has (time, location, weather, tod, dataset, split, seq).
    ``camera`` and ``lidar`` have (time, location, <sensor>_id, seq), their
    value columns, and optionally a column per label table. ``seq`` is unique
    in each and decides which row counts where a key repeats.
    """
    name = lambda t: f"{database}.{t}" if database else t
    rows = _staged(batch["weather"].select("time", "location", "weather", "tod", "dataset", "split", "seq"), root)
    start = next_uid(spark.table(name("weather")), "weather_uid")
    merged = insert_first(touched("weather", rows, database), rows, ["time", "location"], "seq", "weather_uid", start)
    out = {"weather": overwrite_touched(_cast(merged, "weather"), "weather", database)}
    for sensor in ("camera", "lidar"):
        if sensor not in batch:
            continue
        uid, key = f"{sensor}_uid", list(schemas.NATURAL_KEYS[sensor])
        # Sensors may come after their samples, so their own days say where to look.
        keys = touched("weather", batch[sensor].select("time", "location"), database)
        located = require(batch[sensor], keys.select("time", "location", "weather_uid"), ["time", "location"], "sample")
        placed = _staged(_typed(located, sensor, key), root)
        values = [c for c in SENSOR_VALUES[sensor] if c in placed.columns]
        start = next_uid(spark.table(name(sensor)), uid)
        merged = upsert_last(touched(sensor, placed, database), placed, key, "seq", values, uid, start)
        out[sensor] = overwrite_touched(_cast(merged, sensor), sensor, database)
        uids = touched(sensor, placed, database).select(*key, uid)
        for table in LABEL_TABLES[sensor]:
            if table in placed.columns:
                labelled = placed.select(*key, table, "seq").join(uids, key)
                merged = upsert_labels(touched(table, labelled, database), labelled, uid, table, "seq")
                out[table] = overwrite_touched(_cast(merged, table), table, database)
    return out
