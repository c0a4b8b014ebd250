"""Worker shards and reproducible shuffles of a request."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.plans.ordered import ordered_index, ranked


def rows_per_shard(count: int, shards: int, limit: int = 0) -> int:
    """Rows per worker for a request of ``count`` rows (``count`` already honours ``limit``)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    if limit > 0 and limit * shards <= count:
        return math.ceil(limit / shards)
    return max(1, math.ceil(count / shards))


def with_shards(df: DataFrame, order: Sequence[Column], shards: int) -> DataFrame:
    """Adds ``row_idx`` and ``shard``: contiguous, disjoint runs of the order that cover every row."""
    indexed, count = ordered_index(df, order)
    per = rows_per_shard(count, shards)
    return indexed.withColumn("shard", F.floor(F.col("row_idx") / F.lit(per)).cast("long"))


def shuffled(df: DataFrame, key: Sequence[str], seed: int, within: Sequence[str] = ()) -> DataFrame:
    """Seeded permutation of the rows, per ``within`` group, as a ``position`` from 0.

    The draw is an MD5 of seed and key, so any engine can repeat it.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    order = [draw, *[F.col(c) for c in key]]
    if not within:
        return ordered_index(df, order, "position")[0].orderBy("position")
    numbered = ranked(df, within, order, "position").withColumn("position", F.col("position") - 1)
    return numbered.orderBy(*within, "position")
