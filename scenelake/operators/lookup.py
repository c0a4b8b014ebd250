"""Lookups where a missing entry is an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(left: DataFrame, right: DataFrame, on: str | Sequence[str], what: str) -> DataFrame:
    """Join every left row to its entry in ``right``; the job fails on a row without one.

    The check runs inside the join's own pass. It is a filter over both sides,
    so neither column pruning nor outer-join elimination can drop it.
    """
    keys = [on] if isinstance(on, str) else list(on)
    marked = right.withColumn("_found", F.lit(True))
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    failed = F.raise_error(F.concat(F.lit(f"unknown {what}: "), shown)).cast("boolean")
    return left.join(marked, keys, "left").where(F.coalesce(F.col("_found"), failed)).drop("_found")
