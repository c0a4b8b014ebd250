"""Keyed merges as DataFrame expressions; plain Parquet tables have no MERGE.

Duplicates inside a batch are settled by a first-row window. Spark limits its
rows before the shuffle, so a hot key sends one row per task and no payload
moves twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scenelake.plans.ordered import ordered_index


def _one_per_key(batch: DataFrame, key: Sequence[str], seq: str, last: bool) -> DataFrame:
    """Exactly one batch row per key: the one with the lowest or highest ``seq``.

    Among equal ``seq`` the other plain columns decide, smallest first by
    column name; rows equal in all of them are interchangeable.
    """
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    ties = sorted(f.name for f in batch.schema if f.name not in (*key, seq) and not isinstance(f.dataType, nested))
    first = F.col(seq).desc_nulls_last() if last else F.col(seq).asc_nulls_last()
    order = Window.partitionBy(*key).orderBy(first, *[F.col(f"`{c}`").asc_nulls_last() for c in ties])
    return batch.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def first_write(batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    return _one_per_key(batch, key, seq, last=False)


def last_write(batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    return _one_per_key(batch, key, seq, last=True)


def next_uid(existing: DataFrame, uid: str) -> int:
    """First unused identity value of a table."""
    top = existing.agg(F.max(uid).alias("top")).first()["top"]
    return 1 if top is None else top + 1


def assign_uids(rows: DataFrame, key: Sequence[str], uid: str, start: int) -> DataFrame:
    """Consecutive identities from ``start`` in key order."""
    indexed, _ = ordered_index(rows, [F.col(c) for c in key], "_idx")
    return indexed.withColumn(uid, F.col("_idx") + F.lit(start)).drop("_idx")


def insert_first(
    existing: DataFrame, batch: DataFrame, key: Sequence[str], seq: str, uid: str, start: int | None = None
) -> DataFrame:
    """Add batch rows whose key is new; rows already stored stay as they are.

    The result, read by ``key``, is also the map from natural key to uid.
    ``start`` is the first free uid where ``existing`` is only a part of a table.
    """
    fresh = first_write(batch, key, seq).drop(seq).join(existing.select(*key), list(key), "left_anti")
    added = assign_uids(fresh, key, uid, next_uid(existing, uid) if start is None else start)
    return existing.unionByName(added, allowMissingColumns=True)


def upsert_last(
    existing: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    seq: str,
    values: Sequence[str],
    uid: str | None = None,
    start: int | None = None,
) -> DataFrame:
    """Set ``values`` from the batch's last row per key, NULLs included; add new keys.

    Stored rows keep their uid and every column outside ``values``. ``start``
    is the first free uid where ``existing`` is only a part of a table.
    """
    newest = last_write(batch, key, seq).select(*key, *[F.col(c).alias(f"_new_{c}") for c in values])
    newest = newest.withColumn("_hit", F.lit(True))
    merged = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in existing.columns
    ]
    merged += [F.col(f"_new_{c}").alias(c) for c in values if c not in existing.columns]
    if uid is None:
        return existing.join(newest, list(key), "full").select(*merged)
    # New keys get their uid on narrow columns; then one full join settles old and new rows alike.
    newest = newest.dropna(subset=list(key))
    new_keys = batch.select(*key).dropna().distinct().join(existing.select(*key), list(key), "left_anti")
    numbered = assign_uids(new_keys, key, "_new_uid", next_uid(existing, uid) if start is None else start)
    settled = existing.join(newest, list(key), "full").join(numbered, list(key), "left")
    return settled.withColumn(uid, F.coalesce(uid, "_new_uid")).select(*merged)


def present(batch: DataFrame, payload: str) -> DataFrame:
    """Drop rows without a label payload; an encoded empty list is a payload."""
    kind = batch.schema[payload].dataType.typeName()
    kept = F.col(payload).isNotNull()
    if kind == "string":
        kept = kept & (F.length(payload) > 0)
    elif kind == "binary":
        kept = kept & (F.octet_length(payload) > 0)
    return batch.where(kept)


def upsert_labels(existing: DataFrame, batch: DataFrame, uid: str, payload: str, seq: str) -> DataFrame:
    """Last-write-wins for one label table keyed by ``uid``, skipping absent payloads."""
    return upsert_last(existing, present(batch, payload), [uid], seq, [payload])


def update_column(table: DataFrame, updates: DataFrame, uid: str, column: str) -> DataFrame:
    """Set ``column`` for the uids in ``updates`` (uid, column), one row per uid."""
    new = updates.select(uid, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    return table.join(new, uid, "left").withColumn(column, value).select(table.columns)
