"""One large JSON list of objects, read by many tasks.

A file is cut into byte ranges. A range alone cannot tell whether it starts
inside a string or how deep it is nested, but it can tell how it changes both:
by the parity of its quotes, and by its brackets outside strings under either
assumption. Sums of those changes over the earlier ranges of the file give the
true state at every range's start, so the edges found are those of the list,
whatever its strings hold. Each task then yields the objects that begin in its
range and reads on only for the end of the last one.

Python finds edges only, on whole ranges at once; Spark parses the objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_BYTES = 8 << 20
_FURTHER = 1 << 16  # bytes read on at first for the end of a range's last object
_MOST_TASKS = 20_000
_BACKSLASH, _QUOTE = 92, 34


def open_file(uri: str) -> pa.NativeFile:
    """A file that Spark listed; its path is not percent-encoded."""
    system, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return system.open_input_file(path)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Positions of the quotes that begin or end a string: those after an even run of backslashes."""
    at = np.flatnonzero(data == _QUOTE)
    slashes = np.flatnonzero(data == _BACKSLASH)
    if not len(slashes) or not len(at):
        return at
    # Every backslash knows the first one of its run.
    begins = np.r_[True, np.diff(slashes) > 1]
    first = slashes[np.maximum.accumulate(np.where(begins, np.arange(len(slashes)), 0))]
    before = np.searchsorted(slashes, at) - 1
    escaped = (before >= 0) & (slashes[before] == at - 1) & ((at - first[before]) % 2 == 1)
    return at[~escaped]


def _outside(data: np.ndarray, inside: bool) -> np.ndarray:
    """Which bytes lie outside strings, given the state before the first."""
    parity = np.zeros(len(data), np.uint8)
    parity[_quotes(data)] = 1
    return (np.bitwise_xor.accumulate(parity) if len(parity) else parity) == int(inside)


def _steps(data: np.ndarray) -> np.ndarray:
    """How each byte changes the depth, were it outside strings."""
    opens, closes = (data == ord("{")) | (data == ord("[")), (data == ord("}")) | (data == ord("]"))
    return opens.astype(np.int32) - closes.astype(np.int32)


def _bytes(file: pa.NativeFile, start: int, end: int) -> np.ndarray:
    """The range, led by one backslash if the byte before it is one that escapes."""
    lead = 0
    while start - lead > 0 and file.read_at(1, start - lead - 1) == b"\\":
        lead += 1
    # Pairs of backslashes cancel; one left over escapes the first byte.
    return np.frombuffer((b"\\" if lead % 2 else b"") + file.read_at(end - start, start), np.uint8)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quotes, plain, within = [], [], []
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
            with open_file(path) as file:
                data = _bytes(file, start, end)
            outside, steps = _outside(data, False), _steps(data)
            quotes.append(len(_quotes(data)))
            plain.append(int(steps[outside].sum()))
            within.append(int(steps[~outside].sum()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("path", "start", "end")), *(pa.array(x, pa.int64()) for x in (quotes, plain, within))],
            names=["path", "start", "end", "quotes", "plain", "within"],
        )


def objects(file: pa.NativeFile, start: int, end: int, inside: bool, depth: int) -> Iterator[bytes]:
    """The list's objects that begin in the range, given the state at its start."""
    size, further = file.size(), 0
    while True:
        stop = min(end + further, size)
        data = _bytes(file, start, stop)
        lead = len(data) - (stop - start)
        steps = np.where(_outside(data, inside), _steps(data), 0)
        after = depth + np.cumsum(steps, dtype=np.int64)
        begins = np.flatnonzero((steps == 1) & (after == 2) & (data == ord("{")))
        begins = begins[begins < lead + end - start]
        ends = np.flatnonzero((steps == -1) & (after == 1))
        closed = np.searchsorted(ends, begins)
        if not len(begins) or closed[-1] < len(ends):
            break
        if stop == size:
            raise ValueError("a JSON list ends inside an object")
        further = max(2 * further, _FURTHER)
    text = data.tobytes()
    for a, b in zip(begins.tolist(), ends[closed].tolist() if len(begins) else [], strict=True):
        yield text[a : b + 1]


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("path", "start", "end", "inside", "depth")
    for batch in batches:
        for path, start, end, inside, depth in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            with open_file(path) as file:
                values = [v.decode() for v in objects(file, start, end, inside, depth)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])


def read_json_list(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of ``schema`` from JSON lists of objects; fields that are not named are not parsed.

    An object that does not parse fails the job, and so does a list that ends early. A file without a list has no rows.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(1, -(-total // range_bytes)), _MOST_TASKS)
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = (
        listed.where("length > 0")
        .select("path", "length", F.explode(starts).alias("start"))
        .select("path", "start", F.least("length", F.col("start") + range_bytes).alias("end"))
    )
    changes = ranges.repartition(tasks, "path", "start").mapInArrow(
        _changes, "path string, start long, end long, quotes long, plain long, within long"
    )
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = changes.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    known = known.withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("plain")))
    known = known.withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    texts = known.select("path", "start", "end", "inside", "depth").repartition(tasks, "path", "start").mapInArrow(
        _objects, "value string"
    )
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return texts.select(parsed.alias("row")).select("row.*")
