"""Continuous ingest: new files become batches of keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def watch(
    spark: SparkSession,
    schema: T.StructType | str,
    path: str,
    pattern: str = "*",
    archive: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Stream of the files arriving in ``path``; consumed files move to ``archive`` when given."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def first_per_sample(stream: DataFrame, time: str = "time", delay: str = "10 minutes") -> DataFrame:
    """First row per (time, location) within the delay.

    Older duplicates pass here and are dropped by the keyed insert behind it.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([time, "location"])


def into_batches(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Run ``apply(batch, batch id)`` on every micro-batch.

    After a failure a batch comes again under its id, so what ``apply`` writes
    must follow from the id alone.
    """
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process what has arrived so far into Parquet files below ``output``."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()


def version_of(spark: SparkSession, root: str, schema: str, batch_id: int) -> DataFrame:
    """The store as the batches before ``batch_id`` left it."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v{batch_id}")


def write_version(df: DataFrame, root: str, batch_id: int) -> None:
    """Write the store after ``batch_id``; a repeated batch replaces what its first try left."""
    df.write.mode("overwrite").parquet(f"{root}/v{batch_id + 1}")
