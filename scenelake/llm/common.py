"""What several corpus operators share: table access, working folders and word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.session import configure, shared_dir

# The six ASCII blanks that end a word.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

ARROW_ROWS = 500  # documents per Arrow batch; a batch is what a Python worker holds at once

ARROW_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` in a session whose Arrow batches are small, so that long texts stay within a worker's memory."""
    conf = configure(df.sparkSession).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` for what is computed inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def working_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def whole(text: Column | str) -> Column:
    """A text in which null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
