"""Aggregates over a time range around each probe, without forming pairs.

Time is cut into blocks as long as the range, so a range touches exactly two
blocks: the tail of one and the head of the next. One running aggregate per
direction then answers every probe, at a cost linear in rows however many
values a range holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.plans.ordered import running_both_ways

# At equal times values sit between the probes, so both range ends are inclusive.
_TAIL, _VALUE, _HEAD = 0, 1, 2


def range_aggregate(
    values: DataFrame,
    probes: DataFrame,
    group: str,
    width_us: int,
    agg: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column],
) -> DataFrame:
    """For each probe, ``agg`` of the values with ``start <= at <= start + width_us``.

    ``values`` has columns (group, at, value), ``probes`` has (group, probe_id,
    start), with ``at`` and ``start`` in microseconds. Returns (probe_id,
    result) for the probes whose range holds a value. Probes in blocks without
    values leave before the sort.
    """
    kind = values.schema["value"].dataType
    block = lambda at: F.floor(at / F.lit(width_us)).cast("long")
    have = values.select(
        F.col(group).alias("_g"),
        block(F.col("at")).alias("_block"),
        F.col("at").alias("_at"),
        F.lit(_VALUE).alias("_side"),
        F.lit(None).cast(probes.schema["probe_id"].dataType).alias("_probe"),
        F.col("value").alias("_value"),
    )
    ends = F.array(
        F.struct(F.lit(_TAIL).alias("_side"), F.col("start").alias("_at")),
        F.struct(F.lit(_HEAD).alias("_side"), (F.col("start") + F.lit(width_us)).alias("_at")),
    )
    ask = (
        probes.select(F.col(group).alias("_g"), F.col("probe_id").alias("_probe"), F.inline(ends))
        .withColumn("_block", block(F.col("_at")))
        .join(have.select("_g", "_block").distinct(), ["_g", "_block"], "left_semi")
        .withColumn("_value", F.lit(None).cast(kind))
    )
    rows = have.unionByName(ask)
    spread = F.xxhash64("_probe")  # lets equal times of one group span several slices
    order = [F.col("_at"), F.col("_side"), spread]
    ran = running_both_ways(rows, ["_g", "_block"], order, "_value", agg, merge)
    answer = F.when(F.col("_side") == _TAIL, F.col("_from_on")).otherwise(F.col("_up_to"))
    return (
        ran.where(F.col("_side") != _VALUE)
        .select(F.col("_probe").alias("probe_id"), answer.alias("_part"))
        .where("_part IS NOT NULL")
        .groupBy("probe_id")
        .agg(agg(F.col("_part")).alias("result"))
    )
