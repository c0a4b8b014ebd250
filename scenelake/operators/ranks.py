"""Points in many boxes that are turned alike, by ranks.

In the axes of such boxes every box is a range of z and of the two ground axes, so counting needs no point
tests. A sweep's points are cut into chunks of ``CHUNK`` rows along z. A chunk wholly inside a
box adds its number, one wholly outside ends there, and the others are counted by a task per chunk and some
``BATCH`` boxes: points are numbered along each axis, a box becomes three ranges of
numbers, and tables of running counts answer those in some log2(CHUNK) squared steps, however
many points the box holds or its faces cut.

Counts are those of the plain test, rounding included. Along z the faces are searched with that test itself. On
the ground the test subtracts before it turns, so points nearer to a face than rounding reaches are tested one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.plans.ordered import ranked
from scenelake.session import materialise

CHUNK = 1 << 18  # points a task numbers
BATCH = 1 << 17  # boxes a task counts, about
LEAST = 64  # boxes of a turn, and points of their sweep, from which this pays
POINTS_PER_BOX = 64  # with fewer boxes of a turn, the pyramid does less

_BOX = ("b_x", "b_y", "b_z", "b_length", "b_width", "b_height")
_ROUNDING = 2.0**-48  # above what the steps of the test lose, relative to the coordinates' sizes
_FAR = 1e100  # below it nothing overflows
_PAIRS = 1 << 20  # pairs tested one by one at a time


# -- one chunk -----------------------------------------------------------------


def _reached(values: np.ndarray, center: np.ndarray, bound: np.ndarray, beyond: bool) -> np.ndarray:
    """Per box the first of the ascending ``values`` whose distance from the center is at (or ``beyond``) the bound."""
    low, high = np.zeros(len(center), np.int64), np.full(len(center), len(values), np.int64)
    for _ in range(len(values).bit_length()):
        middle = (low + high) >> 1
        away = values[np.minimum(middle, len(values) - 1)] - center
        met = (away > bound if beyond else away >= bound) | (middle >= high)
        low, high = np.where(met, low, middle + 1), np.where(met, np.minimum(middle, high), high)
    return low


class _Axis:
    """Order of the points along one axis, and the ranges of ranks that boxes take in it.

    Points from ``low`` to ``high`` are surely inside, those before ``least`` or from ``most`` on surely outside.
    """

    def __init__(self, values: np.ndarray, center: np.ndarray, half: np.ndarray, slack: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        self.rank = np.empty(len(values), np.int64)
        self.rank[self.order] = np.arange(len(values))
        ascending = values[self.order]
        self.low = _reached(ascending, center, slack - half, beyond=False)
        self.high = np.maximum(self.low, _reached(ascending, center, half - slack, beyond=True))
        self.least = np.minimum(self.low, _reached(ascending, center, -half - slack, beyond=False))
        self.most = np.maximum(self.high, _reached(ascending, center, half + slack, beyond=True))

    def surely(self, point: np.ndarray, box: np.ndarray) -> np.ndarray:
        return (self.rank[point] >= self.low[box]) & (self.rank[point] < self.high[box])


def _below(values: np.ndarray, bits: int, start: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of ``values[start:end]`` are below ``bound``: bit by bit, zeros moved to the front each time."""
    total = np.zeros(len(bound), np.int64)
    for bit in reversed(range(bits)):
        zero = (values >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero, dtype=np.int32)])
        values = np.concatenate([values[zero], values[~zero]])
        a, b = zeros[start], zeros[end]
        one = (bound >> bit) & 1 == 1
        total += np.where(one, b - a, 0)
        start, end = np.where(one, zeros[-1] + start - a, a), np.where(one, zeros[-1] + end - b, b)
    return total


def _in_ranges(up: _Axis, along: _Axis, across: _Axis) -> np.ndarray:
    """Points surely inside each box: a range of z is cut into runs of 2^k ranks, each kept in order of the second axis."""
    n = len(up.order)
    counts = up.high - up.low
    whole = (along.low == 0) & (along.high == n) & (across.low == 0) & (across.high == n)
    none = (counts == 0) | (along.low == along.high) | (across.low == across.high)
    counts[none] = 0
    box = np.flatnonzero(~whole & ~none)
    counts[box] = 0
    # The ranks below the range's end, less those below its start.
    box, upto, sign = np.tile(box, 2), np.concatenate([up.high[box], up.low[box]]), np.repeat([1, -1], len(box))
    second, third = along.rank[up.order], across.rank[up.order].astype(np.int32)
    bits = n.bit_length()
    for level in range(bits):
        chosen = np.flatnonzero((upto >> level) & 1)
        if not len(chosen):
            continue
        keys = (np.arange(n) >> level) * n + second
        order = np.argsort(keys)
        keys, here = keys[order], box[chosen]
        run = ((upto[chosen] >> level) - 1) * n
        start, end = (np.searchsorted(keys, run + side[here]) for side in (along.low, along.high))
        bounds = np.concatenate([across.high[here], across.low[here]])
        held = _below(third[order], bits, np.tile(start, 2), np.tile(end, 2), bounds)
        found = sign[chosen] * (held[: len(here)] - held[len(here) :])
        counts += np.bincount(here, weights=found, minlength=len(counts)).astype(np.int64)
    return counts


def _near_faces(points: np.ndarray, boxes: np.ndarray, cos: float, sin: float, axes: Sequence[_Axis]) -> np.ndarray:
    """Points inside each box that are too near to a face to be told by their rank."""
    counts = np.zeros(len(boxes), np.int64)
    for k, axis in enumerate(axes):
        starts = np.concatenate([axis.least, axis.high])
        lengths = np.concatenate([axis.low - axis.least, axis.most - axis.high])
        box = np.tile(np.arange(len(boxes)), 2)[lengths > 0]
        starts, lengths = starts[lengths > 0], lengths[lengths > 0]
        ends = np.cumsum(lengths)
        for first in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
            at = np.arange(first, min(first + _PAIRS, int(ends[-1])))
            run = np.searchsorted(ends, at, side="right")
            b, p = box[run], axis.order[starts[run] + at - (ends[run] - lengths[run])]
            dx, dy, dz = (points[p, i] - boxes[b, i] for i in range(3))
            inside = (np.abs(cos * dx + sin * dy) <= boxes[b, 3] / 2) & (np.abs(cos * dy - sin * dx) <= boxes[b, 4] / 2)
            inside &= np.abs(dz) <= boxes[b, 5] / 2
            # A point near faces of two axes counts with the first of them.
            for earlier in axes[:k]:
                inside &= earlier.surely(p, b)
            counts += np.bincount(b[inside], minlength=len(boxes))
    return counts


def held(points: np.ndarray, boxes: np.ndarray, cos: float, sin: float) -> np.ndarray:
    """Points (n x 3) inside each box (x, y, z, length, width, height), all turned by one angle; faces included."""
    if not len(points):
        return np.zeros(len(boxes), np.int64)
    (x, y, z), (bx, by, bz) = points.T, boxes[:, :3].T
    half = boxes[:, 3:].T / 2
    exact = np.zeros(len(boxes))
    # Unturned, the test looks at one coordinate alone.
    slack = _ROUNDING * ((np.abs(x) + np.abs(y)).max() + np.abs(bx) + np.abs(by)) if sin else exact
    axes = (
        _Axis(z, bz, half[2], exact),
        _Axis(cos * x + sin * y, cos * bx + sin * by, half[0], slack),
        _Axis(cos * y - sin * x, cos * by - sin * bx, half[1], slack),
    )
    return _in_ranges(*axes) + _near_faces(points, boxes, cos, sin, axes)


# -- all chunks ----------------------------------------------------------------


def _turned(x: Column, y: Column) -> tuple[Column, Column]:
    cos, sin = F.col("_cos"), F.col("_sin")
    return cos * x + sin * y, cos * y - sin * x


def _near(*columns: str) -> Column:
    """Neither null nor too far for the sums below; NaN counts as larger than any number."""
    return reduce(Column.__and__, [F.coalesce(F.abs(c) < _FAR, F.lit(False)) for c in columns])


def shared_turns(points: DataFrame, sized: DataFrame, sweep: str) -> DataFrame:
    """(sweep, _cos, _sin) of turns that many boxes of a sweep have, at most one for some boxes; materialised."""
    tame = sized.where(_near(*_BOX, "_cos", "_sin"))
    turns = tame.groupBy(sweep, "_cos", "_sin").agg(F.count("*").alias("_boxes")).where(F.col("_boxes") >= LEAST)
    turns = materialise(turns)
    if turns.isEmpty():
        return turns.drop("_boxes")
    wanted = turns.select(sweep).distinct()
    sizes = points.join(wanted, sweep, "left_semi").groupBy(sweep).agg(F.count("*").alias("_points"))
    pays = (F.col("_points") >= LEAST) & (F.col("_points") <= F.col("_boxes") * POINTS_PER_BOX)
    return materialise(turns.join(sizes, sweep).where(pays).drop("_boxes", "_points"))


def divide(sized: DataFrame, turns: DataFrame, sweep: str) -> tuple[DataFrame, DataFrame]:
    """The boxes of the given turns, and the others."""
    marked = sized.join(turns.withColumn("_shared", F.lit(True)), [sweep, "_cos", "_sin"], "left")
    alike = F.coalesce("_shared", F.lit(False)) & _near(*_BOX)
    return marked.where(alike).drop("_shared"), marked.where(~alike).drop("_shared")


def _side(chunk_low: Column, chunk_high: Column, center: Column, half: Column, slack: Column) -> tuple[Column, Column]:
    """Whether a chunk is wholly inside a box along one axis, and whether it is wholly outside."""
    low, high = chunk_low - center, chunk_high - center
    return (low >= slack - half) & (high <= half - slack), (high < -half - slack) | (low > half + slack)


def _classified() -> Column:
    """1 for a chunk wholly inside the box, -1 for one wholly outside, 0 for others."""
    u, v = _turned(F.col("b_x"), F.col("b_y"))
    slack = F.lit(_ROUNDING) * (F.col("_reach") + F.abs("b_x") + F.abs("b_y"))
    sides = [
        _side(F.col(f"_min{a}"), F.col(f"_max{a}"), center, F.col(f"b_{size}") / 2, margin)
        for a, center, size, margin in (
            ("z", F.col("b_z"), "height", F.lit(0.0)), ("u", u, "length", slack), ("v", v, "width", slack)
        )
    ]
    inside, outside = zip(*sides, strict=True)
    return F.when(reduce(Column.__or__, outside), -1).when(reduce(Column.__and__, inside), 1).otherwise(0)


def count(points: DataFrame, boxes: DataFrame, turns: DataFrame, sweep: str) -> DataFrame:
    """(sweep, box_idx, _n): points in boxes, in parts to be summed.

    ``boxes`` (sweep, box_idx, b_x to b_height, _cos, _sin) are those of ``turns``.
    """
    turn = [sweep, "_cos", "_sin"]
    near = points.select(sweep, *[F.col(a).cast("double").alias(a) for a in "xyz"]).where(_near("x", "y", "z"))
    numbered = ranked(near.join(turns, sweep), turn, [F.col(a) for a in "zxy"], "_rn")
    cut = numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / CHUNK)).drop("_rn")
    u, v = _turned(F.col("x"), F.col("y"))
    extremes = [f(c).alias(f"_{n}{a}") for a, c in (("z", F.col("z")), ("u", u), ("v", v)) for f, n in ((F.min, "min"), (F.max, "max"))]
    chunks = cut.groupBy(*turn, "_chunk").agg(
        F.count("*").alias("_n"), F.max(F.abs("x") + F.abs("y")).alias("_reach"), *extremes
    )
    met = materialise(
        boxes.join(chunks, turn)
        .withColumn("_part", _classified())
        .where("_part >= 0")
        .select(*turn, "_chunk", "box_idx", *_BOX, "_n", "_part")
    )
    place = [*turn, "_chunk"]
    visits = met.where("_part = 0").drop("_n", "_part")
    batches = materialise(visits.groupBy(*place).agg(F.ceil(F.count("*") / BATCH).cast("int").alias("_batches")))
    dealt = visits.join(batches, place).withColumn("_batch", F.pmod(F.xxhash64("box_idx", *_BOX), "_batches").cast("int"))
    copies = cut.join(batches, place).withColumn("_batch", F.explode(F.sequence(F.lit(0), F.col("_batches") - 1)))
    out = T.StructType([boxes.schema[sweep], boxes.schema["box_idx"], T.StructField("_n", T.LongType())])

    def counted(key: tuple[pa.Scalar, ...], some: pa.Table, of: pa.Table) -> pa.Table:
        flat = lambda t, names: np.column_stack([t.column(c).to_numpy() for c in names])
        n = held(flat(some, "xyz"), flat(of, _BOX), key[1].as_py(), key[2].as_py())
        return pa.table({sweep: pa.repeat(key[0], of.num_rows), "box_idx": of.column("box_idx"), "_n": pa.array(n, pa.int64())})

    at = [*place, "_batch"]
    # Both sides come from the same chunks, so one side's keys get names of their own.
    own = [f"_own_{c}" for c in at]
    border = (
        copies.select(*[F.col(c).alias(o) for c, o in zip(at, own, strict=True)], "x", "y", "z")
        .groupBy(*own)
        .cogroup(dealt.select(*at, "box_idx", *_BOX).groupBy(*at))
        .applyInArrow(counted, out)
    )
    return met.where("_part = 1").select(sweep, "box_idx", "_n").unionByName(border).where("_n > 0")
