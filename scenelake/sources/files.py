"""Discovery and reading of raw files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from scenelake.functions import paths
from scenelake.sources.jsonlist import open_file

BLOB_BYTES = 32 << 20


def list_files(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(path, length) of the files below ``root`` with the extension; contents are not read."""
    glob = "*." + extension.lstrip(".")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )


def split_files(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """The listing with the split folder and recording context of every file."""
    path = F.col("path")
    return list_files(spark, root, extension).select(
        "path", paths.split_of(path).alias("split"), paths.context_name(path).alias("context")
    )


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark itself would resolve it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _with_contents(root: str, extension: str, column: str, strict: bool, batch_bytes: int):
    """Adds each row's file to batches of narrow rows; what a batch holds is bounded by bytes, or is one file."""
    ending = "." + extension.lstrip(".")

    def contents(name: str | None) -> bytes | None:
        try:
            if name is not None and name.endswith(ending):
                with open_file(f"{root}/{name}") as file:
                    return file.read()
        except FileNotFoundError:
            pass
        if strict:
            raise FileNotFoundError(f"unknown file: {name}")
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, start = [], 0, 0
            for name in batch.column("filename").to_pylist():
                held.append(contents(name))
                size += len(held[-1] or b"")
                if size >= batch_bytes or start + len(held) == batch.num_rows:
                    rows = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(held, pa.binary())], names=[*rows.schema.names, column]
                    )
                    held, size, start = [], 0, start + len(held)

    return run


def attach_blobs(
    spark: SparkSession,
    metadata: DataFrame,
    root: str,
    extension: str,
    column: str = "image",
    strict: bool = True,
    batch_bytes: int = BLOB_BYTES,
) -> DataFrame:
    """Add the contents of each row's file, named by ``filename`` relative to ``root``.

    Tasks open the named files and no others; only the narrow rows are dealt to
    them, no contents are shuffled. A row without a file fails the job; lenient
    mode leaves its contents NULL.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*metadata.schema.fields, StructField(column, BinaryType())])
    read = _with_contents(qualified(spark, root).rstrip("/"), extension, column, strict, batch_bytes)
    return metadata.repartition(tasks, "filename").mapInArrow(read, schema)


def sidecars(labels: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Companion paths of each label file, NULL where the listing lacks the file.

    One join for all companions: expected paths become rows and fold back.
    """
    expected = paths.label_companions(F.col(path))
    wanted = labels.select(
        F.col(path).alias("label"),
        paths.sensor_name(F.col(path)).alias("sensor"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("want")) for k, p in expected.items()])),
    )
    present = listing.select(F.col("path").alias("want"), F.lit(True).alias("here")).distinct()
    found = wanted.join(present, "want", "left").withColumn("have", F.when(F.col("here"), F.col("want")))
    return found.groupBy("label", "sensor").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("have"))).alias(k) for k in expected]
    )


def _channels_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored bytes are rows of BGR(A) pixels; the result is one plane per channel, red first."""
    for batch in batches:
        pixels = []
        for h, w, c, raw in zip(*(batch.column(x).to_pylist() for x in ("height", "width", "channels", "data")), strict=True):
            image = np.frombuffer(raw, np.uint8).reshape(h, w, c)
            if c >= 3:
                image = image[:, :, [2, 1, 0, *range(3, c)]]
            pixels.append((image.transpose(2, 0, 1).ravel() / np.float32(255)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ("path", "height", "width", "channels")), pa.array(pixels, pa.list_(pa.float32()))],
            names=["path", "height", "width", "channels", "pixels"],
        )


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, channels, pixels) of the image files below ``root``.

    Pixels lie in [0, 1], channel by channel (red, green, blue), row by row.
    """
    images = spark.read.format("image").option("recursiveFileLookup", True).load(root)
    return images.select(
        F.col("image.origin").alias("path"),
        "image.height",
        "image.width",
        F.col("image.nChannels").alias("channels"),
        "image.data",
    ).mapInArrow(_channels_first, "path string, height int, width int, channels int, pixels array<float>")
