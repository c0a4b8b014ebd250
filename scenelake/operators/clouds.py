"""Point clouds: points in boxes, masks, sampling, augmentation, class probabilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_POINTS = 16384

_SLACK = 1e-6  # keeps points on a box face within the reach searched


def _held(points: np.ndarray, boxes: np.ndarray) -> list[int]:
    """Points (n x 3) inside each box (x, y, z, length, width, height, yaw), faces included."""
    points = points[np.argsort(points[:, 0], kind="stable")]
    out = []
    for x, y, z, length, width, height, yaw in boxes:
        # Only points within the footprint's reach along x come into question.
        reach = np.hypot(length, width) / 2 + _SLACK
        near = points[np.searchsorted(points[:, 0], x - reach) : np.searchsorted(points[:, 0], x + reach, side="right")]
        dx, dy, dz = near[:, 0] - x, near[:, 1] - y, near[:, 2] - z
        cos, sin = np.cos(yaw), np.sin(yaw)
        inside = (np.abs(cos * dx + sin * dy) <= length / 2) & (np.abs(cos * dy - sin * dx) <= width / 2)
        out.append(int((inside & (np.abs(dz) <= height / 2)).sum()))
    return out


_BOX_FIELDS = ("x", "y", "z", "length", "width", "height", "yaw")


def box_counts(df: DataFrame, points: str, boxes: str, name: str = "counts") -> DataFrame:
    """Adds ``name``, how many of the row's points lie in each of the row's boxes.

    A row that holds its points and boxes is counted where it is; nothing is
    exploded or shuffled. A missing cloud counts as empty, a missing box list
    gives an empty list.
    """

    def flat(column: pa.Array, fields: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        values = column.flatten()
        rows = np.column_stack([values.field(a).to_numpy(zero_copy_only=False).astype(np.float64) for a in fields])
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return rows, np.concatenate([[0], np.cumsum(lengths)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (p, at), (b, to) = flat(batch.column(points), "xyz"), flat(batch.column(boxes), _BOX_FIELDS)
            held = [_held(p[at[i] : at[i + 1]], b[to[i] : to[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(held, pa.list_(pa.int64()))], [*batch.schema.names, name]
            )

    return df.mapInArrow(count, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]))


def points_in_origin_box(points: DataFrame, width: float, length: float, height: float) -> DataFrame:
    """Points within an upright box around the origin, faces included; x pairs with width, y with length."""
    inside = (
        (F.abs("x") <= width / 2) & (F.abs("y") <= length / 2) & (F.abs("z") <= height / 2)
    )
    return points.agg(F.count_if(inside).alias("n_points"))


def valid_returns(ranges: Column, labels: Column) -> Column:
    """Labels of the returns with a positive range; a sensor without labels gives an empty array."""
    pairs = F.arrays_zip(ranges.alias("range"), labels.alias("label"))
    kept = F.transform(F.filter(pairs, lambda r: r["range"] > 0), lambda r: r["label"])
    return F.when(labels.isNull(), F.array().cast("array<int>")).otherwise(kept)


def usable_sweeps(sweeps: DataFrame, segmentation: str = "lidar_segmentation", boxes: str = "lidar_box") -> DataFrame:
    """Sweeps with a nonzero label, or from a frame with boxes (the list itself may be empty)."""
    labelled = F.exists(F.col(segmentation), lambda x: x != 0)
    return sweeps.where(F.coalesce(labelled, F.lit(False)) | F.col(boxes).isNotNull())


def concat_sensors(sweeps: DataFrame, frame: Sequence[str], sensor: str, points: str = "points") -> DataFrame:
    """One row per frame and point, sensors in name order: (frame, sensor, pt_idx, x, y, z).

    Points stay rows, since a frame's sensors together may exceed one row.
    """
    return sweeps.select(*frame, sensor, F.posexplode(points).alias("pt_idx", "_p")).select(
        *frame, sensor, "pt_idx", "_p.*"
    )


def split_features(rows: Column) -> Column:
    """Rows (range, intensity, elongation, x, y, z) as a struct of features and points."""
    features = F.transform(rows, lambda r: F.slice(r, 1, 3))
    points = F.transform(rows, lambda r: F.struct(r[3].alias("x"), r[4].alias("y"), r[5].alias("z")))
    return F.struct(features.alias("features"), points.alias("points"))


def split_intensity(rows: Column) -> Column:
    """Rows (x, y, z, intensity, ...) as a struct of features and points."""
    features = F.transform(rows, lambda r: F.slice(r, 4, 1))
    points = F.transform(rows, lambda r: F.struct(r[0].alias("x"), r[1].alias("y"), r[2].alias("z")))
    return F.struct(features.alias("features"), points.alias("points"))


def flip(points: Column, key: Column, seed: int) -> Column:
    """One of four flips per cloud (none, -x, -y, both), fixed by seed and key."""
    # The first hex digit of an MD5, which any engine can repeat.
    digit = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 1)
    draw = F.pmod(F.instr(F.lit("0123456789abcdef"), digit) - 1, F.lit(4))
    sign_x = F.when(draw.isin(1, 3), F.lit(-1.0)).otherwise(F.lit(1.0)).cast("float")
    sign_y = F.when(draw.isin(2, 3), F.lit(-1.0)).otherwise(F.lit(1.0)).cast("float")
    return F.transform(
        points,
        lambda p: F.struct((p["x"] * sign_x).alias("x"), (p["y"] * sign_y).alias("y"), p["z"].alias("z")),
    )


def quantize(probabilities: Column) -> Column:
    """Probabilities as whole 255ths, truncated."""
    return F.transform(probabilities, lambda p: F.floor(p.cast("double") * 255).cast("smallint"))


def normalize_classes(prediction: Column) -> Column:
    """Class-by-pixel scores over their sum per pixel; NULL where the sum is 0."""
    doubles = F.transform(prediction, lambda row: F.transform(row, lambda x: x.cast("double")))
    zero = F.transform(F.element_at(doubles, 1), lambda x: F.lit(0.0))
    total = F.aggregate(doubles, zero, lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
    return F.transform(doubles, lambda row: F.zip_with(row, total, F.try_divide))


def _farthest(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of ``n`` points, each the farthest from those before it; starts at index 0."""
    if len(points) <= n:
        return np.arange(len(points))
    picked = np.zeros(n, dtype=np.int64)
    nearest = np.full(len(points), np.inf)
    for i in range(1, n):
        step = points - points[picked[i - 1]]
        np.minimum(nearest, np.einsum("ij,ij->i", step, step), out=nearest)
        picked[i] = nearest.argmax()
    return np.sort(picked)


def farthest_points(
    df: DataFrame, npts: int = SAMPLE_POINTS, points: str = "points", keep: Sequence[str] = ()
) -> DataFrame:
    """(keep, picked): indices of ``npts`` points spread over each cloud.

    Works on one cloud per row, so no grouping and no shuffle; a cloud of at
    most ``npts`` points is kept whole. Labels and features follow by index,
    see ``take``. Arrow batches are bounded in bytes, not only in rows.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clouds = batch.column(points)
            flat = clouds.flatten()
            rows = np.column_stack([flat.field(a).to_numpy(zero_copy_only=False).astype(np.float64) for a in "xyz"])
            ends = np.concatenate([[0], np.cumsum(clouds.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            picks = [_farthest(rows[a:b], npts) for a, b in zip(ends, ends[1:])]
            picked = pa.array(picks, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], picked], [*keep, "picked"])

    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("picked", T.ArrayType(T.IntegerType()))])
    return df.select(*dict.fromkeys([*keep, points])).mapInArrow(sample, schema)


def take(values: Column, picked: Column) -> Column:
    """Elements of an array at the picked indices."""
    return F.transform(picked, lambda i: F.get(values, i))


def downsample(lidar: DataFrame, npts: int = SAMPLE_POINTS, aligned: Sequence[str] = ()) -> DataFrame:
    """``<column>_downsampled`` for the points and every column aligned with them, in one pass."""
    small = {f"{c}_downsampled": take(F.col(c), F.col("picked")) for c in ("points", *aligned)}
    kept = [c for c in lidar.columns if c not in small]
    return farthest_points(lidar, npts, keep=kept).withColumns(small).drop("picked")
