"""Sharding by sampled splitters, in DataFrame functions only: shards of near equal bytes that are ranges of a key.

The key is a 60-bit hash of the text, then doc_id: copies of a text lie side by
side, so they share a shard or a run of neighbouring ones. A row weighs its bytes.

1. Narrow rows (key and size) are written once; everything but the last step reads only them.
2. Rows are drawn with a chance in proportion to their size, by a hash of seed and key; each stands for an equal
   share of all bytes. Quantiles of the draw are the splitters of ``RANGES`` ranges a shard, or of ranges of
   ``RANGE_BYTES`` where that gives more.
3. Every range is measured exactly. A range that holds more than twice its share (hot keys, an unlucky draw) is
   drawn from again and subdivided, until none is left that has more than one key.
4. A range in which a shard becomes full is cut at the key where that happens, found by running sums inside
   those ranges alone, of which there are fewer than shards.
5. Records find their range by binary search in the splitters and move once, to their range, where they are
   numbered; a range's first slot is known from the measured ranges.

A key belongs to the shard in which the middle of its bytes falls when all keys stand in order. The draw thus
decides how the work is cut, not the result, and SQL can state it. Beside totals the driver handles the table
of ranges, some 50 bytes each; at ``RANGE_BYTES`` that is a five-millionth of the data.

Defined cases: null and empty texts weigh ``ROW_BYTES`` and share a hash; a null doc_id sorts as the smallest
integer; rows equal in text and doc_id share a key, and so a range and a shard, in which their slots are
interchangeable; a text of any length is one record; fewer records than shards leave shards empty; an empty table
gives an empty result; ``shard`` keeps all columns, its own ones replace any named alike.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import whole, working_folder

SHARDS = 40
ROW_BYTES = 16  # what a record takes beside its text
RANGES = 32  # ranges a shard, at least
RANGE_BYTES = 256 << 20
DRAWN = 8  # rows drawn per range
SEED = 42

_LEAST = -(1 << 63)
_KEY = ("_h", "_d")


def _keyed(text: Column, doc_id: Column) -> list[Column]:
    """Key and size of a record."""
    return [
        F.conv(F.substring(F.md5(whole(text)), 1, 15), 16, 10).cast("long").alias("_h"),
        F.coalesce(doc_id.cast("long"), F.lit(_LEAST)).alias("_d"),
        (F.octet_length(whole(text)) + ROW_BYTES).cast("long").alias("_size"),
    ]


def _key() -> Column:
    return F.struct(*[F.col(c) for c in _KEY])


def _constant(values: list, kind: str) -> Column:
    """An array that all tasks know, spelled in JSON; Spark folds it into one literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _located(keyed: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``_range`` of each row: how many of the sorted bounds its key reaches, by binary search."""
    known = _constant([{"_h": h, "_d": d} for h, d in bounds], "array<struct<_h: bigint, _d: bigint>>")
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    return keyed.withColumn(
        "_range",
        F.aggregate(
            F.lit(steps),
            F.lit(0),
            # get() is null beyond the end, which is no bound reached.
            lambda at, step: F.when(F.get(known, at + step - 1) <= _key(), at + step).otherwise(at),
        ),
    )


def _drawn(rows: DataFrame, share: float, seed: int, level: int) -> DataFrame:
    """Rows drawn with chance size / ``share``; each stands for ``share`` bytes, or for its own if these are more."""
    number = F.xxhash64(F.lit(seed), F.lit(level), *_KEY).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return rows.where(number * F.lit(share) < F.col("_size")).withColumn(
        "_weight", F.greatest(F.lit(share), F.col("_size").cast("double"))
    )


def _quantiles(drawn: DataFrame, step: float, group: tuple[str, ...] = ()) -> set[tuple[int, int]]:
    """Keys at which the drawn weight of a group passes a multiple of ``step``. Reads some ``DRAWN`` rows per range."""
    order = Window.partitionBy(*group).orderBy(*_KEY)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passing = (
        drawn.withColumn("_passed", F.floor(F.sum("_weight").over(upto) / F.lit(step)))
        .withColumn("_was", F.lag("_passed", 1, 0).over(order))
        .where("_passed > _was")
        .select(*_KEY)
    )
    return {tuple(r) for r in passing.collect()}


def _measured(located: DataFrame) -> list[Row]:
    """Rows, bytes and extreme keys of every range that has rows, in order."""
    extremes = [f(c).alias(f"{name}{c}") for c in _KEY for f, name in ((F.min, "least"), (F.max, "most"))]
    rows = located.groupBy("_range").agg(F.count("*").alias("rows"), F.sum("_size").alias("bytes"), *extremes).collect()
    return sorted(rows, key=lambda r: r["_range"])


def _several_keys(r: Row) -> bool:
    return r["least_h"] < r["most_h"] or r["least_d"] < r["most_d"]


def _subdivided(
    narrow: DataFrame, bounds: set[tuple[int, int]], share: float, seed: int
) -> tuple[set[tuple[int, int]], list[Row]]:
    """Bounds between which every range holds at most twice ``share`` bytes or a single key, and the ranges."""
    level = 0
    while True:
        level += 1
        located = _located(narrow, sorted(bounds))
        ranges = _measured(located)
        over = [r for r in ranges if r["bytes"] > 2 * share and _several_keys(r)]
        if not over:
            return bounds, ranges
        numbers = {r["_range"] for r in over}
        flags = _constant([i in numbers for i in range(len(bounds) + 1)], "array<boolean>")
        inside = _drawn(located.where(F.get(flags, F.col("_range"))), share / DRAWN, seed, level)
        # The largest hash, or the largest key of a hash, splits any range of several keys: every pass gets on.
        split = {(r["most_h"], _LEAST if r["least_h"] < r["most_h"] else r["most_d"]) for r in over}
        bounds = bounds | split | _quantiles(inside, share, ("_range",))


def _before(ranges: list[Row]) -> dict[int, int]:
    """Bytes of all earlier ranges."""
    sums = accumulate((r["bytes"] for r in ranges), initial=0)
    return {r["_range"]: b for r, b in zip(ranges, sums, strict=False)}


def _cuts(located: DataFrame, ranges: list[Row], n: int, total: int, shards: int) -> set[tuple[int, int]]:
    """First keys of the shards inside those ranges that more than one shard shares."""
    before = _before(ranges)
    shared = {
        r["_range"]: before[r["_range"]]
        for r in ranges
        if _several_keys(r)
        # The shards in which the first and the last byte fall.
        and before[r["_range"]] * shards // total < (before[r["_range"]] + r["bytes"] - 1) * shards // total
    }
    starts = _constant([shared.get(i) for i in range(n + 1)], "array<bigint>")
    keys = (
        located.withColumn("_start", F.get(starts, F.col("_range")))
        .where("_start IS NOT NULL")
        .groupBy("_range", "_start", *_KEY)
        .agg(F.sum("_size").alias("_bytes"))
    )
    earlier = Window.partitionBy("_range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    middle = "2 * (_start + coalesce(_earlier, 0)) + _bytes"
    first = (
        keys.withColumn("_earlier", F.sum("_bytes").over(earlier))
        .withColumn("shard", F.expr(f"({middle}) * {shards} div {2 * total}"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy("_range", "shard").orderBy(*_KEY)))
        .where("_rn = 1")
        .select(*_KEY)
    )
    return {tuple(r) for r in first.collect()}


@dataclass(frozen=True)
class Range:
    """A run of keys: from the ``number``-th bound on, all in one shard, in which its first row has ``first_slot``."""

    number: int
    shard: int
    first_slot: int
    rows: int
    bytes: int


def splitters(
    documents: DataFrame, shards: int = SHARDS, ranges: int = RANGES, seed: int = SEED
) -> tuple[list[tuple[int, int]], list[Range]]:
    """Sorted bounds, and the ranges between them that hold rows."""
    folder = working_folder(documents.sparkSession, "splitters")
    documents.select(*_keyed(F.col("text"), F.col("doc_id"))).write.parquet(folder)
    narrow = documents.sparkSession.read.parquet(folder)
    total = narrow.agg(F.sum("_size").alias("t")).first()["t"] or 0
    if not total:
        return [], []
    share = total / max(shards * ranges, math.ceil(total / RANGE_BYTES))
    drawn = _quantiles(_drawn(narrow, share / DRAWN, seed, 0), share)
    bounds, measured = _subdivided(narrow, drawn, share, seed)
    located = _located(narrow, sorted(bounds))
    bounds = sorted(bounds | _cuts(located, measured, len(bounds), total, shards))
    measured = _measured(_located(narrow, bounds))
    before, slots, placed = _before(measured), Counter(), []
    for r in measured:
        own = (2 * before[r["_range"]] + r["bytes"]) * shards // (2 * total)
        placed.append(Range(r["_range"], own, slots[own], r["rows"], r["bytes"]))
        slots[own] += r["rows"]
    return bounds, placed


def shard(documents: DataFrame, shards: int = SHARDS, ranges: int = RANGES, seed: int = SEED) -> DataFrame:
    """All columns, ``size``, ``shard`` and ``slot`` (from 0 without a gap in each shard), range-partitioned."""
    bounds, placed = splitters(documents, shards, ranges, seed)
    of_range = {r.number: {"shard": r.shard, "first_slot": r.first_slot} for r in placed}
    known = _constant(
        [of_range.get(i) for i in range(len(bounds) + 1)], "array<struct<shard: int, first_slot: bigint>>"
    )
    kept = [c for c in documents.columns if c.lower() not in ("size", "shard", "slot")]
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"))
    order = Window.partitionBy("_range").orderBy(*_KEY)
    return (
        _located(packed.select("_doc", *_keyed(F.col("_doc.text"), F.col("_doc.doc_id"))), bounds)
        .withColumn("_rn", F.row_number().over(order))
        .withColumn("_place", F.get(known, F.col("_range")))
        .select(
            "_doc.*",
            F.col("_size").alias("size"),
            F.col("_place.shard").alias("shard"),
            (F.col("_place.first_slot") + F.col("_rn") - 1).cast("long").alias("slot"),
        )
    )


def write_shards(documents: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """The records as Parquet below ``folder/shard=<n>``, each file in the order of its slots."""
    sharded = shard(documents, shards)
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def placements(sharded: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of sharded records."""
    return sharded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "size",
        F.crc32(F.encode(whole("text"), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The checksum's table follows from its polynomial, 3988292384.
SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8)::UBIGINT[],
                          lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT),
                          i::UBIGINT) ORDER BY i) AS t
  FROM range(256) r(i)
), d AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                        lambda b: ('0x' || b)::UBIGINT) AS bytes
  FROM documents
), k AS (
  SELECT doc_id, h, sum(size) AS key_size,
         coalesce(sum(sum(size)) OVER (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  0) AS before,
         sum(sum(size)) OVER () AS total
  FROM d GROUP BY doc_id, h
), p AS (
  SELECT d.*, ((2 * k.before + k.key_size) * 40 // (2 * k.total))::INTEGER AS shard
  FROM d JOIN k ON d.h = k.h AND d.doc_id IS NOT DISTINCT FROM k.doc_id
)
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::INT]), 4294967295::UBIGINT),
           4294967295::UBIGINT)::BIGINT AS text_crc32,
       'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM p, crc_table
"""
