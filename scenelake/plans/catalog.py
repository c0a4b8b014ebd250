"""Tables, their columns and the foreign-key graph that joins them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import takewhile
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]


class Edge(NamedTuple):
    """One join step: ``target`` joins ``source`` on every column pair."""

    source: str
    target: str
    pairs: tuple[tuple[str, str], ...]


class Catalog:
    """Named DataFrames plus declared keys; Parquet itself carries neither.

    ``trusted`` states that the foreign keys were validated, which lets a
    request skip a parent table it only passes through.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        keys: Mapping[str, Sequence[str]],
        foreign_keys: Iterable[ForeignKey],
        trusted: bool = False,
    ):
        self.tables = dict(tables)
        self.keys = {name: tuple(cols) for name, cols in keys.items()}
        self.foreign_keys = tuple(
            fk for fk in foreign_keys if fk.child in self.tables and fk.parent in self.tables
        )
        self.trusted = trusted
        self._footers: dict[str, DataFrame] = {}

    @classmethod
    def of_parquet(
        cls,
        spark: SparkSession,
        paths: Mapping[str, str],
        keys: Mapping[str, Sequence[str]],
        foreign_keys: Iterable[ForeignKey],
        trusted: bool = False,
    ) -> Catalog:
        """Parquet folders as tables, whose ``profile`` reads footers where it can."""
        out = cls({n: spark.read.parquet(p) for n, p in paths.items()}, keys, foreign_keys, trusted)
        # The v2 source answers counts from footers; the source is chosen when the read is declared.
        setting = "spark.sql.sources.useV1SourceList"
        before = spark.conf.get(setting)
        spark.conf.set(setting, ",".join(x for x in before.split(",") if x != "parquet"))
        try:
            out._footers = {n: spark.read.schema(out.tables[n].schema).parquet(p) for n, p in paths.items()}
        finally:
            spark.conf.set(setting, before)
        return out

    @classmethod
    def of_database(cls, spark: SparkSession, database: str | None = None, trusted: bool = False) -> Catalog:
        """The scene tables of a Spark database."""
        from scenelake import schemas

        prefix = f"{database}." if database else ""
        found = {t.name for t in spark.catalog.listTables(database)}
        tables = {n: spark.table(prefix + n) for n in schemas.TABLES if n in found}
        return cls(tables, schemas.KEYS, schemas.FOREIGN_KEYS, trusted)

    def table(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise ValueError(f"unknown table {name!r}; known: {sorted(self.tables)}") from None

    def owners(self, column: str) -> list[str]:
        return [name for name, df in self.tables.items() if column in df.columns]

    def owner(self, column: str) -> str:
        """The single table holding ``column``; a filter column must not be ambiguous."""
        owners = self.owners(column)
        if len(owners) != 1:
            raise ValueError(f"column {column!r} needs exactly one owning table, found {owners}")
        return owners[0]

    def listing(self, spark: SparkSession) -> DataFrame:
        """One row per column: table, ordinal, column, type."""
        rows = [
            (name, i, field.name, field.dataType.simpleString())
            for name, df in self.tables.items()
            for i, field in enumerate(df.schema.fields, 1)
        ]
        return spark.createDataFrame(
            rows, "table_name STRING, ordinal BIGINT, column_name STRING, data_type STRING"
        )

    def profile(self) -> DataFrame:
        """The listing with each column's non-null count.

        Tables ``of_parquet`` answer from their footers. A footer counts the
        leaves of nested columns, so those and what stands behind them are
        scanned, as are all columns of other tables: one aggregate per table.
        """
        parts = []
        for name, df in self.tables.items():
            numbered = list(enumerate(df.schema.fields, 1))
            flat = numbered
            if name in self._footers:
                flat = list(takewhile(lambda f: not isinstance(f[1].dataType, (ArrayType, MapType, StructType)), numbered))
            for source, fields in ((self._footers.get(name, df), flat), (df, numbered[len(flat) :])):
                if fields:
                    parts.append(_non_null(name, source, fields))
        return reduce(DataFrame.unionByName, parts)

    def foreign_key_listing(self, spark: SparkSession) -> DataFrame:
        rows = [
            (fk.child, c, fk.parent, p)
            for fk in self.foreign_keys
            for c, p in zip(fk.child_cols, fk.parent_cols)
        ]
        return spark.createDataFrame(
            rows, "child STRING, child_col STRING, parent STRING, parent_col STRING"
        )

    def _neighbours(self, name: str) -> list[Edge]:
        pairs: dict[str, list[tuple[str, str]]] = {}
        for fk in self.foreign_keys:
            columns = list(zip(fk.child_cols, fk.parent_cols))
            if fk.child == name:
                pairs.setdefault(fk.parent, []).extend(columns)
            elif fk.parent == name:
                pairs.setdefault(fk.child, []).extend((p, c) for c, p in columns)
        return [Edge(name, other, tuple(pairs[other])) for other in sorted(pairs)]

    def shortest_path(self, start: str, end: str) -> list[Edge]:
        """Fewest joins from ``start`` to ``end``; equal lengths go by table name."""
        came_by: dict[str, Edge | None] = {start: None}
        queue = deque([start])
        while queue and end not in came_by:
            for edge in self._neighbours(queue.popleft()):
                if edge.target not in came_by:
                    came_by[edge.target] = edge
                    queue.append(edge.target)
        if end not in came_by:
            raise ValueError(f"no foreign-key path from {start!r} to {end!r}")
        path: list[Edge] = []
        edge = came_by[end]
        while edge is not None:
            path.insert(0, edge)
            edge = came_by[edge.source]
        return path

    def join_path(self, tables: Sequence[str]) -> list[Edge]:
        """Join steps that reach every table, in request order, each table joined once."""
        joined = {tables[0]}
        steps: list[Edge] = []
        for start, end in zip(tables, tables[1:]):
            for edge in self.shortest_path(start, end):
                if edge.target not in joined:
                    steps.append(edge)
                    joined.add(edge.target)
        return steps

    def skip_unused_parents(self, steps: list[Edge], used: set[str]) -> list[Edge]:
        """Join siblings on their shared foreign key when their parent is not read.

        Valid only for validated, non-null foreign keys onto a unique key.
        """
        if not self.trusted:
            return steps
        kept = list(steps)
        for step in steps:
            parent = step.target
            children = [s for s in kept if s.source == parent]
            if parent in used or len(children) != 1:
                continue
            (out,) = children
            into = [p for _, p in step.pairs]
            if into != [p for p, _ in out.pairs] or tuple(into) != self.keys.get(parent):
                continue
            if not self._is_child(step.source, parent) or not self._is_child(out.target, parent):
                continue
            pairs = tuple((a, b) for (a, _), (_, b) in zip(step.pairs, out.pairs))
            at = kept.index(out)
            kept[at] = Edge(step.source, out.target, pairs)
            kept.remove(step)
        return kept

    def _is_child(self, child: str, parent: str) -> bool:
        return any(fk.child == child and fk.parent == parent for fk in self.foreign_keys)

    def join(self, start: str, steps: Sequence[Edge]) -> DataFrame:
        """Inner equi-joins along ``steps``; columns stay addressable as ``table.column``."""
        out = self.table(start).alias(start)
        for step in steps:
            condition: Column = reduce(
                Column.__and__,
                [F.col(f"{step.source}.{a}") == F.col(f"{step.target}.{b}") for a, b in step.pairs],
            )
            out = out.join(self.table(step.target).alias(step.target), condition, "inner")
        return out


def _non_null(name: str, df: DataFrame, fields: Sequence[tuple[int, StructField]]) -> DataFrame:
    """One row per column of ``fields`` with its ordinal, type and non-null count."""
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in fields])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f"c{i}").alias("non_null"),
            )
            for i, f in fields
        ]
    )
    return counts.select(F.lit(name).alias("table_name"), F.inline(rows))
