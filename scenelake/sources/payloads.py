"""Encoded array payloads (.npy, .npz, gray PNG) as typed columns.

Python only turns bytes into one flat array per row; shapes and structs are
built from it by column expressions.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.operators.clouds import normalize_classes

_FLAT = T.StructType(
    [T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.FloatType()))]
)

DECODED = 1 << 23  # bytes of decoded values sent back at a time; a larger payload goes alone
_ROWS = 10_000


def _unfilter(rows: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Undo PNG scanline filters of an 8-bit gray image, a run of scanlines at a time."""
    height, width = rows.shape
    out = np.zeros((height + 1, width), dtype=np.uint8)  # the line above the first is 0
    # Kinds 0 and 1 look at their own line, 2 at the one above, 3 and 4 at both.
    sort = np.where(filters < 2, 0, np.where(filters == 2, 1, 2))
    cuts = np.flatnonzero(np.diff(sort)) + 1
    for a, b in zip([0, *cuts], [*cuts, height], strict=True):
        run = rows[a:b]
        if sort[a] == 0:
            out[a + 1 : b + 1] = np.where(filters[a:b, None] == 1, np.cumsum(run, axis=1, dtype=np.uint8), run)
        elif sort[a] == 1:
            out[a + 1 : b + 1] = np.cumsum(np.concatenate([out[a : a + 1], run]), axis=0, dtype=np.uint8)[1:]
        else:
            _both_ways(run, filters[a:b] == 4, out[a : b + 1])
    return out[1:]


def _both_ways(run: np.ndarray, paeth: np.ndarray, out: np.ndarray) -> None:
    """Lines that need their left and upper pixels, by anti-diagonals; ``out`` begins with the line above."""
    height, width = run.shape
    grid = np.zeros((height + 1, width + 1), dtype=np.int16)
    grid[0, 1:] = out[0]
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = grid[y + 1, x], grid[y, x + 1], grid[y, x]
        base = left + up - corner
        near = np.stack([np.abs(base - left), np.abs(base - up), np.abs(base - corner)]).argmin(axis=0)
        guess = np.where(paeth[y], np.choose(near, [left, up, corner]), (left + up) // 2)
        grid[y + 1, x + 1] = (run[y, x] + guess) & 255
    out[1:] = grid[1:, 1:]


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit, non-interlaced gray PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, color, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit gray label rasters are supported")
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    return _unfilter(lines[:, 1:], lines[:, 0])


def _decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def _decode_probs(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)["probs"]


def _decode_cloud_file(data: bytes) -> np.ndarray:
    """Raw sweep file: five floats per point (x, y, z, intensity, ring)."""
    return np.frombuffer(data, np.float32).reshape(-1, 5)[:, :4]


def _decode_label_file(data: bytes) -> np.ndarray:
    """Raw label file: one byte per point."""
    return np.frombuffer(data, np.uint8)


def _frames(arrays: Iterator[np.ndarray | None]) -> Iterator[pd.DataFrame]:
    """Shapes and flat values, in frames of some ``DECODED`` bytes."""
    shapes: list[np.ndarray | None] = []
    values: list[np.ndarray | None] = []
    held = 0
    for array in arrays:
        shapes.append(None if array is None else np.array(array.shape, np.int32))
        values.append(None if array is None else array.ravel().astype(np.float32))
        held += 0 if array is None else values[-1].nbytes
        if held >= DECODED or len(values) >= _ROWS:
            yield pd.DataFrame({"shape": shapes, "data": values})
            shapes, values, held = [], [], 0
    if values:
        yield pd.DataFrame({"shape": shapes, "data": values})


def _flattener(decode: Callable[[bytes], np.ndarray]) -> Callable[[Column], Column]:
    """An Arrow batch is bounded by its payloads, which may be far smaller than what they decode to; so frames are cut anew."""

    @F.pandas_udf(_FLAT)
    def flat(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            yield from _frames(None if b is None else decode(b) for b in payloads)

    return flat


_flat_npy = _flattener(_decode_npy)
_flat_probs = _flattener(_decode_probs)
_flat_png = _flattener(decode_png)
flat_cloud_file = _flattener(_decode_cloud_file)
flat_label_file = _flattener(_decode_label_file)


def _rows(flat: Column, count: Column, width: Column) -> Column:
    """Cut a flat array into ``count`` rows of ``width``."""
    return F.when(count == 0, F.array().cast("array<array<float>>")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(flat, i * width + 1, width))
    )


def points(flat: Column) -> Column:
    """N x 3 payload as a cloud; further columns of a row are ignored."""
    rows = _rows(flat["data"], flat["shape"][0], flat["shape"][1])
    return F.transform(rows, lambda r: F.struct(*[F.get(r, i).alias(a) for i, a in enumerate("xyz")]))


def features(flat: Column) -> Column:
    width = F.coalesce(F.get(flat["shape"], 1), F.lit(1))
    return _rows(flat["data"], flat["shape"][0], width)


def labels(flat: Column) -> Column:
    """Label raster with one id per point."""
    return flat["data"].cast("array<smallint>")


def raster(flat: Column) -> Column:
    """Label raster with its height and width."""
    return F.struct(
        flat["shape"][0].alias("height"), flat["shape"][1].alias("width"), labels(flat).alias("labels")
    )


def probabilities(flat: Column) -> Column:
    """Class axis first, pixels flattened, stored as 255ths: normalised per pixel."""
    classes = flat["shape"][0]
    width = (F.size(flat["data"]) / classes).cast("int")
    return F.transform(
        normalize_classes(_rows(flat["data"], classes, width)), lambda row: row.cast("array<float>")
    )


# Payload column: how its bytes become arrays, and what the arrays become.
DECODERS: dict[str, tuple[Callable, Callable[[Column], Column]]] = {
    "camera_segmentation": (_flat_png, raster),
    "prediction": (_flat_probs, probabilities),
    "prediction_downsampled": (_flat_probs, probabilities),
    "points": (_flat_npy, points),
    "points_downsampled": (_flat_npy, points),
    "features": (_flat_npy, features),
    "features_downsampled": (_flat_npy, features),
    "lidar_segmentation": (_flat_png, labels),
    "lidar_segmentation_downsampled": (_flat_png, labels),
}


def decode(df: DataFrame, decoders: dict | None = None) -> DataFrame:
    """Replace known binary payload columns by typed arrays; other columns pass through."""
    decoders = DECODERS if decoders is None else decoders
    found = [f.name for f in df.schema.fields if f.name in decoders and isinstance(f.dataType, T.BinaryType)]
    flat = df.withColumns({f"_flat_{c}": decoders[c][0](F.col(c)) for c in found})
    shaped = {
        c: F.when(F.col(f"_flat_{c}.shape").isNotNull(), decoders[c][1](F.col(f"_flat_{c}"))) for c in found
    }
    return flat.withColumns(shaped).select(df.columns)
