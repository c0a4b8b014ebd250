"""Key, null and reference checks, cascading deletes and key changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.plans.catalog import Catalog, ForeignKey
from scenelake.session import materialise


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_null) for the columns that hold NULLs though they must not."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns]
    return counts.select(F.inline(F.array(*pairs))).where("n_null > 0")


def orphans(catalog: Catalog, fk: ForeignKey) -> DataFrame:
    """Foreign-key values without a parent, with the number of child rows.

    Children are counted per value before the join, so a hot value is one row there.
    """
    child = catalog.table(fk.child)
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in fk.child_cols])
    per_value = child.where(complete).groupBy(*fk.child_cols).agg(F.count("*").alias("n_rows"))
    parent = catalog.table(fk.parent).select(
        *[F.col(p).alias(c) for c, p in zip(fk.child_cols, fk.parent_cols)]
    )
    return per_value.join(parent, list(fk.child_cols), "left_anti")


def reference_report(catalog: Catalog) -> DataFrame:
    """One row per foreign key: child rows, and how many point nowhere."""
    parts = []
    for fk in catalog.foreign_keys:
        # A multi-column key names its parts in order, joined by commas.
        head = [fk.child, ",".join(fk.child_cols), fk.parent, ",".join(fk.parent_cols)]
        names = ["child", "child_col", "parent", "parent_col"]
        total = catalog.table(fk.child).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("o"))
        lost = orphans(catalog, fk).agg(
            F.lit(0).cast("long").alias("n"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("o")
        )
        parts.append(
            total.unionAll(lost)
            .agg(F.sum("n").alias("n_rows"), F.sum("o").alias("n_orphans"))
            .select(*[F.lit(v).alias(k) for k, v in zip(names, head)], "n_rows", "n_orphans")
        )
    return reduce(DataFrame.unionAll, parts)


def _downwards(catalog: Catalog, table: str) -> list[str]:
    """``table`` and the tables that refer to it, parents before children; self-references aside."""
    below, queue = {table}, [table]
    edges = {(fk.parent, fk.child) for fk in catalog.foreign_keys if fk.parent != fk.child}
    while queue:
        parent = queue.pop()
        fresh = {c for p, c in edges if p == parent} - below
        below |= fresh
        queue += fresh
    order: list[str] = []
    while len(order) < len(below):
        ready = sorted(t for t in below if t not in order and all(p in order for p, c in edges if c == t and p in below))
        if not ready:
            raise ValueError(f"foreign keys form a ring: {sorted(below - set(order))}")
        order += ready
    return order


def _referenced(catalog: Catalog, table: str) -> list[str]:
    """Columns of a table that some foreign key points to."""
    return list(dict.fromkeys(c for fk in catalog.foreign_keys if fk.parent == table for c in fk.parent_cols))


def _keys(rows: DataFrame, fk: ForeignKey) -> DataFrame:
    """Key values of parent rows under their names in the child."""
    return rows.select(*[F.col(p).alias(c) for c, p in zip(fk.child_cols, fk.parent_cols)]).distinct()


def cascade_delete(catalog: Catalog, table: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table after deleting the keys in ``doomed`` and all rows that refer to them.

    ``doomed`` holds the key columns of ``table``. Tables are walked parents
    first. The lost keys of a table, only the columns that others point to,
    are materialised once; each table is read once for them and once for
    what is left. A table that refers to itself is followed until no row is
    added.
    """
    left, gone = dict(catalog.tables), {}
    for name in _downwards(catalog, table):
        rows, needed = catalog.table(name), _referenced(catalog, name)
        lost = [(fk.child_cols, _keys(gone[fk.parent], fk)) for fk in catalog.foreign_keys
                if fk.child == name and fk.parent in gone and fk.parent != name]
        if name == table:
            lost.append((tuple(catalog.keys[table]), doomed.select(*catalog.keys[table]).distinct()))
        own = [fk for fk in catalog.foreign_keys if fk.child == fk.parent == name]
        if needed:
            columns = list(dict.fromkeys([*needed, *(c for cols, _ in lost for c in cols)]))
            hit = reduce(DataFrame.unionAll, [rows.select(*columns).join(k, list(c), "left_semi").select(*needed) for c, k in lost])
            gone[name] = materialise(hit.distinct())
            for fk in own:
                gone[name], more = _followed(rows, fk, gone[name], needed)
                lost.append((fk.child_cols, more))
        left[name] = reduce(lambda df, ck: df.join(ck[1], list(ck[0]), "left_anti"), lost, rows).select(rows.columns)
    return left


def _followed(rows: DataFrame, fk: ForeignKey, lost: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lost keys after following a table's reference to itself, and those keys under the child's names."""
    columns = list(dict.fromkeys([*needed, *fk.child_cols]))
    frontier = lost
    while not frontier.isEmpty():
        found = rows.select(*columns).join(_keys(frontier, fk), list(fk.child_cols), "left_semi").select(*needed).distinct()
        frontier = materialise(found.join(lost, needed, "left_anti"))
        lost = materialise(lost.unionAll(frontier))
    return lost, _keys(lost, fk)


def cascade_update(catalog: Catalog, table: str, changes: DataFrame) -> dict[str, DataFrame]:
    """Every table after giving rows of ``table`` new keys, and all references to them.

    ``changes`` holds the key columns of ``table`` and ``new_<column>`` for
    each, one row per key. Where a changed reference is itself referred to,
    the change travels on, parents first.
    """
    left = dict(catalog.tables)
    key = list(catalog.keys[table])
    moves: dict[str, list[tuple[tuple[str, ...], DataFrame]]] = {table: [(tuple(key), changes)]}
    for name in _downwards(catalog, table):
        for columns, mapping in moves.get(name, []):
            left[name] = _renamed(left[name], columns, mapping)
        for fk in catalog.foreign_keys:
            if fk.parent != name:
                continue
            for columns, mapping in moves.get(name, []):
                shared = [(c, p) for c, p in zip(fk.child_cols, fk.parent_cols) if p in columns]
                if len(shared) != len(fk.parent_cols) or set(columns) != set(fk.parent_cols):
                    continue
                told = materialise(
                    mapping.select(*[F.col(p).alias(c) for c, p in shared], *[F.col(f"new_{p}").alias(f"new_{c}") for c, p in shared])
                )
                if fk.child == name:
                    left[name] = _renamed(left[name], fk.child_cols, told)
                else:
                    moves.setdefault(fk.child, []).append((tuple(fk.child_cols), told))
    return left


def _renamed(rows: DataFrame, columns: Sequence[str], mapping: DataFrame) -> DataFrame:
    """Rows with the values of ``columns`` replaced where the mapping has them."""
    told = mapping.withColumn("_hit", F.lit(True))
    new = {c: F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    return rows.join(told, list(columns), "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])
