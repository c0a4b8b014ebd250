"""Points in boxes by a pyramid of counts: blocks of neighbouring points, blocks of blocks, and so on.

Points are range-partitioned along a Z-order curve and cut into blocks of ``BLOCK``
rows, so blocks follow the density: a crowded spot has many small ones, empty
space has none. A block keeps its points, their number and the
tightest upright box around them; the levels above keep number and box of ``BLOCK`` nodes each.

Boxes start at the top. A node that lies wholly inside a box adds its number, one
wholly outside ends there, and only nodes on the box's border go on to their
children; points are tested in border blocks alone. So the work grows with a box's
border, not with what it holds.

That border is wide where many boxes crowd a sweep, so boxes of a sweep that share a yaw go to ``ranks``.

The test of a corner is the test of a point, and each of its steps is monotonic
in the point's coordinates, rounding included. Where all corners of a node
pass (or all fail on one side), so do all its points: counts are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators import ranks
from scenelake.session import materialise

BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS  # rows of a block, and children of a node
_CURVE_BITS = 20  # per axis

_EXTREMES = [(f, a, f"_{name}{a}") for a in "xyz" for f, name in ((F.min, "min"), (F.max, "max"))]


def _along_curve(x: Column, y: Column) -> Column:
    """Position on a Z-order curve through the ground plane; axes are stretched, so fine and wide scenes both resolve."""

    def spread(v: Column) -> Column:
        half = 1 << (_CURVE_BITS - 1)
        steps = F.asinh(v * 100) * 30_000  # within the half up to some 200 km
        n = F.floor(F.greatest(F.lit(-half), F.least(steps, F.lit(half - 1))) + half).cast("long")
        # Masks that put a blank bit after each bit.
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
        return n

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def blocks_of(points: DataFrame, sweep: str) -> DataFrame:
    """(sweep, _node, _n, box around them, _points) for runs of neighbouring points, materialised."""
    numbered = (
        points.select(sweep, *[F.col(a).cast("double").alias(a) for a in "xyz"])
        .where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
        .withColumn("_code", _along_curve(F.col("x"), F.col("y")))
        # The draw divides points that share one spot.
        .withColumn("_draw", F.rand(11))
        .repartitionByRange(sweep, "_code", "_draw")
        .sortWithinPartitions(sweep, "_code", "_draw")
        .withColumn("_node", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    )
    return materialise(
        numbered.groupBy(sweep, "_node").agg(
            F.count("*").alias("_n"),
            *[agg(a).alias(name) for agg, a, name in _EXTREMES],
            F.collect_list(F.struct("x", "y", "z")).alias("_points"),
        )
    )


def levels_above(blocks: DataFrame, sweep: str) -> list[DataFrame]:
    """Nodes of ``BLOCK`` nodes each, level by level, until no sweep has more than ``BLOCK``; the last is the top.

    Node numbers hold the partition in their upper bits, so the last levels join partitions.
    """
    levels = [blocks.drop("_points")]
    while True:
        most = levels[-1].groupBy(sweep).count().agg(F.max("count").alias("m")).first()["m"] or 0
        if most <= BLOCK:
            return levels
        extremes = [agg(name).alias(name) for agg, _, name in _EXTREMES]
        parent = F.shiftright("_node", BLOCK_BITS).alias("_node")
        levels.append(materialise(levels[-1].groupBy(sweep, parent).agg(F.sum("_n").alias("_n"), *extremes)))


def _tested(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A place in the box's own axes; ``_cos`` and ``_sin`` belong to its yaw."""
    dx, dy = x - F.col("b_x"), y - F.col("b_y")
    cos, sin = F.col("_cos"), F.col("_sin")
    return cos * dx + sin * dy, cos * dy - sin * dx, z - F.col("b_z")


def _halves() -> list[Column]:
    return [F.col(f"b_{c}") / 2 for c in ("length", "width", "height")]


def inside() -> Column:
    """Whether point (x, y, z) lies within the box, faces included."""
    places = _tested(*[F.col(a) for a in "xyz"])
    return reduce(Column.__and__, [F.abs(p) <= h for p, h in zip(places, _halves(), strict=True)])


def _classified() -> Column:
    """1 for a node wholly inside the box, -1 for one wholly outside, 0 on the border; null for a box with nulls."""
    corners = [
        _tested(F.col(f"_{i}x"), F.col(f"_{j}y"), F.col(f"_{k}z"))
        for i, j, k in (("min", "min", "min"), ("min", "max", "max"), ("max", "min", "min"), ("max", "max", "max"))
    ]
    within, beyond = [], []
    for axis, half in enumerate(_halves()):
        places = [c[axis] for c in corners]
        within += [F.abs(p) <= half for p in places]
        beyond += [F.least(*places) > half, F.greatest(*places) < -half]
    outside = reduce(Column.__or__, beyond)
    return F.when(outside, -1).when(reduce(Column.__and__, within), 1).when(~outside, 0)


def _sized(boxes: DataFrame, sweep: str) -> DataFrame:
    fields = ("x", "y", "z", "length", "width", "height")
    return boxes.select(
        sweep,
        "box_idx",
        *[F.col(c).cast("double").alias(f"b_{c}") for c in fields],
        F.cos("yaw").alias("_cos"),
        F.sin("yaw").alias("_sin"),
    )


def descend(blocks: DataFrame, levels: list[DataFrame], boxes: DataFrame, sweep: str) -> tuple[list[DataFrame], DataFrame]:
    """What whole nodes add per box, level by level, and the (box, block) pairs on borders."""
    return _descend(levels, _sized(boxes, sweep), sweep)


def _descend(levels: list[DataFrame], sized: DataFrame, sweep: str) -> tuple[list[DataFrame], DataFrame]:
    kept, added, pairs = sized.columns, [], None
    for depth, level in enumerate(reversed(levels)):
        if not depth:
            met = sized.join(level, sweep)
        else:
            children = level.withColumn("_parent", F.shiftright("_node", BLOCK_BITS))
            met = pairs.withColumnRenamed("_node", "_parent").join(children, [sweep, "_parent"])
        met = met.withColumn("_side", _classified())
        added.append(met.where("_side = 1").select(sweep, "box_idx", "_n"))
        pairs = met.where("_side = 0").select(*kept, "_node")
    return added, pairs


def points_in_boxes(points: DataFrame, boxes: DataFrame, sweep: str = "lidar_uid") -> DataFrame:
    """(sweep, box_idx, points_in_box) for the boxes that hold at least one point.

    ``points`` has (sweep, x, y, z); ``boxes`` has (sweep, box_idx, x, y, z,
    length, width, height, yaw in radians). Points and boxes with a null in
    them hold and are held by nothing. Where many boxes of a sweep share a yaw,
    they are counted by ranks (``ranks``), all others by the pyramid.
    """
    sized = _sized(boxes, sweep)
    turns = ranks.shared_turns(points, sized, sweep)
    parts = []
    if not turns.isEmpty():
        alike, sized = ranks.divide(sized, turns, sweep)
        parts.append(ranks.count(points, alike, turns, sweep))
        sized = materialise(sized)
        points = points.join(sized.select(sweep).distinct(), sweep, "left_semi")
    if not parts or not sized.isEmpty():
        parts += _by_pyramid(points, sized, sweep)
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy(sweep, "box_idx").agg(F.sum("_n").cast("long").alias("points_in_box"))


def _by_pyramid(points: DataFrame, sized: DataFrame, sweep: str) -> list[DataFrame]:
    """(sweep, box_idx, _n), in parts to be summed."""
    blocks = blocks_of(points, sweep)
    added, border = _descend(levels_above(blocks, sweep), sized, sweep)
    tested = (
        border.join(blocks.select(sweep, "_node", "_points"), [sweep, "_node"])
        .select(*border.columns, F.inline("_points"))
        .where(inside())
        .groupBy(sweep, "box_idx")
        .agg(F.count("*").alias("_n"))
    )
    return [*added, tested]
