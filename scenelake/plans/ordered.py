"""Global positions, per-group ranks and running aggregates without a one-task window.

Rows are range-partitioned by the whole sort key into slices, so neither a
long result nor a hot group ends up in one task. A slice is numbered locally
and shifted by a carry from the slices before it; there is at most one carry
per slice, which bounds what is collected or broadcast. The slices are
materialised first: a second pass must see the same boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.session import materialise

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def sliced(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """``df`` sorted across slices, with ``_slice`` and the position ``_pos`` inside it."""
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stamped = (
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return materialise(
        stamped.select(
            *df.columns,
            F.shiftright("_id", _POSITION_BITS).cast("int").alias("_slice"),
            F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
        )
    )


def ordered_index(
    df: DataFrame, order: Sequence[Column], name: str = "row_idx", slices: int | None = None
) -> tuple[DataFrame, int]:
    """Number all rows from 0 in ``order``; also returns how many there are.

    ``order`` should be total, or ties are numbered arbitrarily.
    """
    base = sliced(df, order, slices)
    sizes = {r["_slice"]: r["n"] for r in base.groupBy("_slice").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(i, 0)
    shift = F.element_at(F.lit(starts).cast("array<bigint>"), F.col("_slice") + 1) if starts else F.lit(0)
    return base.select(*df.columns, (shift + F.col("_pos")).cast("long").alias(name)), total


def _same_group(left: str, right: str, group: Sequence[str]) -> Column:
    tests = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in group]
    return reduce(Column.__and__, tests, F.col(f"{left}._slice") == F.col(f"{right}._slice"))


def _carry(per_slice: DataFrame, group: Sequence[str], agg: Callable[[Column], Column], back: bool) -> DataFrame:
    """Aggregate of a group's earlier (or, with ``back``, later) slices; at most one row per slice."""
    order = F.col("_slice").desc() if back else F.col("_slice").asc()
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select("_slice", *group, agg(F.col("_part")).over(before).alias("_carry")).where(
        "_carry IS NOT NULL"
    )


def ranked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rn", slices: int | None = None
) -> DataFrame:
    """1-based position of each row in its group, also when one group spans many slices."""
    base = sliced(df, [F.col(c) for c in group] + list(order), slices)
    local = F.row_number().over(Window.partitionBy("_slice", *group).orderBy("_pos"))
    per_slice = base.groupBy("_slice", *group).agg(F.count("*").alias("_part"))
    carry = _carry(per_slice, group, F.sum, back=False)
    return (
        base.withColumn("_rn", local)
        .alias("b")
        .join(F.broadcast(carry).alias("c"), _same_group("b", "c", group), "left")
        .select(
            *[F.col(f"b.{c}") for c in df.columns],
            (F.col("_rn") + F.coalesce(F.col("_carry"), F.lit(0))).cast("long").alias(name),
        )
    )


def running_both_ways(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    value: str,
    agg: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column],
    slices: int | None = None,
) -> DataFrame:
    """Adds ``_up_to`` and ``_from_on``: ``agg`` of ``value`` over the group's rows up to, and
    from, each row. One range partitioning serves both directions.
    """
    base = sliced(df, [F.col(c) for c in group] + list(order), slices)
    local = Window.partitionBy("_slice", *group).orderBy("_pos")
    ahead = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The descending order turns "all following rows" into a running frame.
    behind = (
        Window.partitionBy("_slice", *group)
        .orderBy(F.col("_pos").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    per_slice = base.groupBy("_slice", *group).agg(agg(F.col(value)).alias("_part"))
    out = base.withColumn("_up_to", agg(F.col(value)).over(ahead)).withColumn(
        "_from_on", agg(F.col(value)).over(behind)
    )
    for column, back in (("_up_to", False), ("_from_on", True)):
        carry = _carry(per_slice, group, agg, back)
        out = (
            out.alias("b")
            .join(F.broadcast(carry).alias("c"), _same_group("b", "c", group), "left")
            .select(
                *[F.col(f"b.{c}") for c in out.columns if c != column],
                merge(F.col(f"b.{column}"), F.col("c._carry")).alias(column),
            )
        )
    return out.drop("_slice", "_pos")
