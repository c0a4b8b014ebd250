"""Rigid motions as column expressions.

A point is a tuple of three columns, a quaternion an array (w, x, y, z), a 3x3
or 4x4 matrix an array of 9 or 16 doubles in row order. Every cell of a matrix
is read several times, so pass matrices as columns of the row, not as nested
expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def vector(column: Column) -> Point:
    return column[0], column[1], column[2]


def xyz(point: Column) -> Point:
    """The fields of a point struct as doubles."""
    return tuple(point[axis].cast("double") for axis in "xyz")


def from_cells(cells: list[Column], width: int) -> Column:
    """Matrix column of cells in row order.

    Joining rows keeps the matrix one value per row: a plain array would be
    taken apart by the optimizer and its cells repeated in every use.
    """
    return F.concat(*[F.array(*cells[i : i + width]) for i in range(0, len(cells), width)])


def rotation_cells(q: Column) -> list[Column]:
    """The nine cells of a quaternion's rotation; it need not be normalised."""
    w, x, y, z = q[0], q[1], q[2], q[3]
    s = F.lit(2.0) / (w * w + x * x + y * y + z * z)
    return [
        F.lit(1.0) - s * (y * y + z * z),
        s * (x * y - w * z),
        s * (x * z + w * y),
        s * (x * y + w * z),
        F.lit(1.0) - s * (x * x + z * z),
        s * (y * z - w * x),
        s * (x * z - w * y),
        s * (y * z + w * x),
        F.lit(1.0) - s * (x * x + y * y),
    ]


def rotation_matrix(q: Column) -> Column:
    return from_cells(rotation_cells(q), 3)


def yaw_quaternion(yaw: Column) -> Column:
    """Quaternion of a turn by ``yaw`` radians about z."""
    return F.array(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))


def quaternion_product(a: Column, b: Column) -> Column:
    """Rotation by ``b`` followed by ``a``."""
    aw, ax, ay, az = (a[i] for i in range(4))
    bw, bx, by, bz = (b[i] for i in range(4))
    return F.array(
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def conjugate(q: Column) -> Column:
    """The opposite rotation of a unit quaternion."""
    return F.array(q[0], -q[1], -q[2], -q[3])


def rotation_angle(q: Column) -> Column:
    """Angle of a rotation about its own axis, in radians within (-pi, pi]."""
    half = F.atan2(F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), q[0])
    return F.when(half * 2 > math.pi, half * 2 - 2 * math.pi).otherwise(half * 2)


def quaternion_of(m: Column, stride: int = 3) -> Column:
    """Quaternion of a rotation matrix, or with ``stride=4`` of a 4x4 pose; the sign is arbitrary.

    Divides by the largest component, which keeps the result accurate.
    """
    e = lambda r, c: m[r * stride + c]
    trace = e(0, 0) + e(1, 1) + e(2, 2)
    largest = F.greatest(e(0, 0), e(1, 1), e(2, 2))
    by_w = F.sqrt(F.greatest(trace + 1.0, F.lit(0.0))) * 2
    by_x = F.sqrt(F.greatest(e(0, 0) - e(1, 1) - e(2, 2) + 1.0, F.lit(0.0))) * 2
    by_y = F.sqrt(F.greatest(e(1, 1) - e(0, 0) - e(2, 2) + 1.0, F.lit(0.0))) * 2
    by_z = F.sqrt(F.greatest(e(2, 2) - e(0, 0) - e(1, 1) + 1.0, F.lit(0.0))) * 2
    xy, xz, yz = e(1, 0) + e(0, 1), e(0, 2) + e(2, 0), e(2, 1) + e(1, 2)
    wx, wy, wz = e(2, 1) - e(1, 2), e(0, 2) - e(2, 0), e(1, 0) - e(0, 1)
    return (
        F.when(trace > 0, F.array(by_w / 4, wx / by_w, wy / by_w, wz / by_w))
        .when(e(0, 0) == largest, F.array(wx / by_x, by_x / 4, xy / by_x, xz / by_x))
        .when(e(1, 1) == largest, F.array(wy / by_y, xy / by_y, by_y / 4, yz / by_y))
        .otherwise(F.array(wz / by_z, xz / by_z, yz / by_z, by_z / 4))
    )


def translation_of(pose: Column) -> Column:
    return F.array(pose[3], pose[7], pose[11])


def pose_cells(rotation: Column, translation: Column, inverse: bool = False) -> list[Column]:
    """The 16 cells of the 4x4 matrix of a quaternion and translation, or of the opposite motion."""
    r = rotation_cells(rotation)
    t = vector(translation)
    if inverse:
        rows = [(r[i], r[i + 3], r[i + 6]) for i in range(3)]
        shift = [-(a * t[0] + b * t[1] + c * t[2]) for a, b, c in rows]
    else:
        rows = [(r[3 * i], r[3 * i + 1], r[3 * i + 2]) for i in range(3)]
        shift = list(t)
    cells = [cell for row, s in zip(rows, shift) for cell in (*row, s)]
    return [*cells, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]]


def pose_matrix(rotation: Column, translation: Column, inverse: bool = False) -> Column:
    return from_cells(pose_cells(rotation, translation, inverse), 4)


def matrix_product(a: Column, b: Column) -> Column:
    """Product of two 4x4 matrix columns."""

    def cell(i: Column) -> Column:
        row, column = F.floor(i / 4).cast("int") * 4, i % 4
        return sum(
            (F.get(a, row + k) * F.get(b, column + 4 * k) for k in range(1, 4)), F.get(a, row) * F.get(b, column)
        )

    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def move(m: Column, p: Point) -> Point:
    """4x4 matrix times point."""
    return tuple(m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))


def rotate(p: Point, r: Column | list[Column]) -> Point:
    """Row vector times 3x3 matrix, that is the inverse rotation."""
    return tuple(p[0] * r[i] + p[1] * r[3 + i] + p[2] * r[6 + i] for i in range(3))


def rotate_columns(r: Column | list[Column], p: Point) -> Point:
    """3x3 matrix times column vector."""
    return tuple(r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] for i in range(3))


def translate(p: Point, t: Point) -> Point:
    return tuple(a + b for a, b in zip(p, t))


def lidar_to_ego(p: Point, rotation: Column, translation: Column, mode: str = "rigid") -> Point:
    """Sensor to vehicle. ``as_coded`` applies the inverse rotation and subtracts the translation."""
    r, t = rotation_cells(rotation), vector(translation)
    if mode == "rigid":
        return translate(rotate_columns(r, p), t)
    if mode == "as_coded":
        return tuple(a - b for a, b in zip(rotate(p, r), t))
    raise ValueError(f"unknown mode {mode!r}")


def projection_matrix(intrinsic: Column, rows: int = 3, cols: int = 3) -> Column:
    """Nested intrinsic matrix, up to 4x4, padded to 4x4 with the identity."""
    if rows > 4 or cols > 4:
        raise ValueError("an intrinsic matrix is at most 4x4")
    cells = [
        intrinsic[r][c].cast("double") if r < rows and c < cols else F.lit(1.0 if r == c else 0.0)
        for r in range(4)
        for c in range(4)
    ]
    return from_cells(cells, 4)


def visible(depth: Column, u: Column, v: Column, width: Column, height: Column) -> Column:
    """In front of the camera and inside the image; every bound is strict."""
    inside = (depth > 1.0) & (u > 1) & (u < width - 1) & (v > 1) & (v < height - 1)
    return F.coalesce(inside, F.lit(False))


def project(p: Point, projection: Column, width: Column, height: Column, normalize: bool = True) -> Column:
    """Pinhole projection as a struct (u, v, valid); points behind the camera are kept, not valid."""
    u, v, w = move(projection, p)
    if normalize:
        u, v = F.try_divide(u, w), F.try_divide(v, w)
    return F.struct(u.alias("u"), v.alias("v"), visible(p[2], u, v, width, height).alias("valid"))


def project_clipped(p: Point, projection: Column, width: Column, height: Column) -> Column:
    """Projection of a vehicle-axes camera (x ahead, y left, z up), clipped to the image.

    Points behind the camera become zeros. Lens distortion and the rolling
    shutter are not modelled.
    """
    ahead = F.coalesce(p[0] > 0, F.lit(False))
    u, v, w = move(projection, (-p[1], -p[2], p[0]))

    def clip(value: Column, top: Column) -> Column:
        return F.when(ahead, F.greatest(F.lit(0.0), F.least(F.try_divide(value, w), top.cast("double")))).otherwise(0.0)

    return F.struct(clip(u, width).alias("u"), clip(v, height).alias("v"), ahead.cast("int").alias("valid"))


def box_corner(i: Column, box: Column | str = "") -> Point:
    """Corner ``i`` of a box: bit 1 is +length, bit 0 +width, bit 2 the top.

    ``box`` is a struct column, or empty to read x, y, z, length, width,
    height, yaw (radians) from columns of these names.
    """
    get = (lambda name: F.col(name)) if isinstance(box, str) else (lambda name: box[name])
    sign = lambda bit: F.shiftright(i, bit).bitwiseAND(F.lit(1)).cast("double") - 0.5
    along, across = sign(1) * get("length"), sign(0) * get("width")
    cos, sin = F.cos(get("yaw")), F.sin(get("yaw"))
    return (
        get("x") + cos * along - sin * across,
        get("y") + sin * along + cos * across,
        get("z") + sign(2) * get("height"),
    )
