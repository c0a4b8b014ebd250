"""A page of an ordered result by distributed selection: nothing is sorted, numbered or written as a whole.

A page begins and ends at two positions of the order. The key at a position is
found by counting: keys drawn from the data cut the order into ranges, one
aggregation counts the rows of each, and only the range that holds the
position is drawn from and counted again, until it has at most ``EDGE_ROWS``
rows or one key. Its keys are then ranked in one task. The page is a filter between
two keys; on the leading column it is a plain comparison, which reaches the scan.
If all ranges that a page touches have that few rows, they are sorted as they are.

Keys compare as structs with a null flag before each value, so nulls come last
and any orderable type works. Rows that tie in the whole key are alike to the order;
where a page ends among them, as many as it needs are taken.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EDGE_ROWS = 1 << 16  # rows of a range whose keys one task ranks
RANGES = 256
DRAWN = 16 * RANGES  # keys drawn to find the ranges of one pass

# Every digit of a time survives its spelling.
_SPELLED = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class Cut:
    """Where a position falls: on the ``ties``-th (from 0) of ``rows`` rows with ``key``."""

    key: str
    ties: int
    rows: int


class Selection:
    """Positions in ``df`` ordered by columns, ascending, nulls last."""

    def __init__(
        self, df: DataFrame, order: Sequence[str], edge_rows: int = EDGE_ROWS, ranges: int = RANGES, drawn: int = DRAWN
    ):
        self.df, self.order = df, list(order)
        self.edge_rows, self.ranges, self.drawn = edge_rows, ranges, drawn
        self.kind = df.select(self.key()).schema[0].dataType

    # -- keys ----------------------------------------------------------------

    def key(self, columns: Sequence[Column | None] | None = None) -> Column:
        """The sort key; a missing column comes before everything."""
        fields = []
        for i, c in enumerate(columns or [F.col(f"`{c}`") for c in self.order]):
            if c is None:
                fields += [F.lit(None).cast("int").alias(f"n{i}"), F.lit(None).alias(f"v{i}")]
            else:
                fields += [c.isNull().cast("int").alias(f"n{i}"), c.alias(f"v{i}")]
        return F.struct(*fields)

    def _literal(self, spelled: str, kind: T.DataType) -> Column:
        return F.from_json(F.lit(spelled), kind, _SPELLED)

    def _after(self, key: str | None, inclusive: bool = True) -> list[Column]:
        """Tests that a row comes after a key, the plain one on the leading column first."""
        if key is None:
            return []
        known, first = self._literal(key, self.kind), F.col(f"`{self.order[0]}`")
        plain = first.isNull() if json.loads(key).get("n0") else first.isNull() | (first >= known["v0"])
        return [plain, self.key() >= known if inclusive else self.key() > known]

    def _before(self, key: str | None) -> list[Column]:
        if key is None:
            return []
        known, first = self._literal(key, self.kind), F.col(f"`{self.order[0]}`")
        plain = [] if json.loads(key).get("n0") else [first <= known["v0"]]
        return [*plain, self.key() < known]

    @staticmethod
    def _where(df: DataFrame, tests: list[Column]) -> DataFrame:
        for test in tests:
            df = df.where(test)
        return df

    # -- counting --------------------------------------------------------------

    def _bounds(self, keys: DataFrame, rows: int) -> list[str]:
        """Some ``ranges`` keys, in order, from a draw of about ``drawn`` of ``keys``' ``_key``."""
        rate = min(1.0, self.drawn / max(1, rows))
        some = keys.sample(fraction=rate, seed=7) if rate < 1 else keys
        ordered = F.array_sort(F.collect_set("_key"))
        step = F.greatest(F.lit(1), F.ceil(F.size("k") / self.ranges).cast("int"))
        spelled = (
            some.agg(ordered.alias("k"))
            .select("k", step.alias("s"))
            .select(F.transform(F.filter("k", lambda x, i: i % F.col("s") == 0), lambda x: F.to_json(x, _SPELLED)))
        )
        return list(spelled.first()[0])

    def _counts(self, bounds: list[str], tests: list[Column]) -> list[int]:
        """Rows before the first bound, from each bound to the next, and from the last on."""
        known = self._literal("[" + ",".join(bounds) + "]", T.ArrayType(self.kind))
        steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
        at = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda at, step: F.when(F.get(known, at + step - 1) <= self.key(), at + step).otherwise(at),
        )
        found = self._where(self.df, tests).groupBy(at.alias("_range")).agg(F.count("*").alias("n")).collect()
        counts = {r["_range"]: r["n"] for r in found}
        return [counts.get(i, 0) for i in range(len(bounds) + 1)]

    def _greatest(self, tests: list[Column]) -> str:
        largest = self._where(self.df, tests).agg(F.max(self.key()).alias("k"))
        return largest.select(F.to_json("k", _SPELLED)).first()[0]

    def _cut(self, position: int, bounds: list[str], counts: list[int]) -> Cut:
        low = high = None
        while True:
            at = 0
            while position >= counts[at]:
                position -= counts[at]
                at += 1
            low, high = bounds[at - 1] if at else low, bounds[at] if at < len(bounds) else high
            tests = [*self._after(low), *self._before(high)]
            if counts[at] <= self.edge_rows:
                return self._ranked(position, tests)
            keys = self._where(self.df, tests).select(self.key().alias("_key"))
            # The greatest key divides any range of several keys, so every pass gets on.
            greatest = self._greatest(tests)
            bounds = self._bounds(keys, counts[at])
            if greatest == low or bounds == [greatest] == [low]:
                return Cut(greatest, position, counts[at])
            bounds = [b for b in bounds if b != greatest] + [greatest]
            counts = self._counts(bounds, tests)

    def _ranked(self, position: int, tests: list[Column]) -> Cut:
        """The key at a position of a small range."""
        upto = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (
            self._where(self.df, tests)
            .groupBy(self.key().alias("_key"))
            .agg(F.count("*").alias("rows"))
            .withColumn("upto", F.sum("rows").over(upto))
            .where(F.col("upto") > position)
            .orderBy("upto")
            .limit(1)
            .select(F.to_json("_key", _SPELLED).alias("key"), "rows", "upto")
            .first()
        )
        return Cut(found["key"], position - (found["upto"] - found["rows"]), found["rows"])

    # -- pages -----------------------------------------------------------------

    def page(self, offset: int, limit: int = 0, leading: DataFrame | None = None) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order (0: to the end), in no order.

        ``leading`` may hold the leading column in a narrower place than
        ``df``, such as the table it comes from; the first ranges are drawn there.
        """
        if leading is None:
            keys, rows = self.df.select(self.key().alias("_key")), self.df.count()
        else:
            rest = [None] * (len(self.order) - 1)
            keys, rows = leading.select(self.key([F.col(leading.columns[0]), *rest]).alias("_key")), leading.count()
        bounds = self._bounds(keys, rows)
        counts = self._counts(bounds, [])
        total = sum(counts)
        if limit:
            limit = max(0, min(limit, total - offset))
            small = self._touched(offset, limit, bounds, counts)
            if small is not None:
                return small
        low = self._cut(offset, bounds, counts) if 0 < offset < total else None
        high = self._cut(offset + limit, bounds, counts) if limit and offset + limit < total else None
        if offset >= total:
            return self.df.limit(0)
        if low and high and low.key == high.key:
            return self._where(self.df, self._same(low.key)).limit(limit)
        inner = [*self._after(low.key if low else None, inclusive=not (low and low.ties)), *self._before(high.key if high else None)]
        parts = [self._where(self.df, inner)]
        if low and low.ties:
            parts.append(self._where(self.df, self._same(low.key)).limit(low.rows - low.ties))
        if high and high.ties:
            parts.append(self._where(self.df, self._same(high.key)).limit(high.ties))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _touched(self, offset: int, limit: int, bounds: list[str], counts: list[int]) -> DataFrame | None:
        """The page out of the ranges it touches, if these have no more rows than one task may sort."""
        ends = list(accumulate(counts))
        first = next((i for i, e in enumerate(ends) if e > offset), len(ends))
        last = next((i for i, e in enumerate(ends) if e >= offset + limit), len(ends) - 1)
        if not limit or sum(counts[first : last + 1]) > self.edge_rows:
            return None
        low, high = bounds[first - 1] if first else None, bounds[last] if last < len(bounds) else None
        rows = self._where(self.df, [*self._after(low), *self._before(high)])
        skip = offset - (ends[first] - counts[first])
        return rows.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in self.order]).offset(skip).limit(limit)

    def _same(self, key: str) -> list[Column]:
        return [*self._after(key), self.key() <= self._literal(key, self.kind)]
