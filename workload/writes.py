"""Upserts, surrogate keys, ranks, integrity checks and cascading deletes."""

from __future__ import annotations

from pyspark.sql import functions as F
from functools import reduce
from pyspark.sql import DataFrame

from scenelake.operators import integrity, upserts
from scenelake.plans.catalog import Catalog, ForeignKey
from scenelake.plans.ordered import ranked
from workload.registry import query, table, view, view_sql
from workload.requests import STAR_KEYS, STAR_TABLES, star

_KEY = ["o_custkey", "o_orderdate"]

# Stored rows: the first finished order per key. Batch: all orders, in key order of arrival.
_UPSERT_SQL = """
WITH stored AS (SELECT o_orderkey AS uid, o_custkey, o_orderdate, o_totalprice AS price FROM orders
    WHERE o_orderstatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1),
batch AS (SELECT o_custkey, o_orderdate, o_totalprice AS price, o_orderkey AS seq FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey {way}) = 1),
fresh AS (SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM stored s
    WHERE s.o_custkey = b.o_custkey AND s.o_orderdate = b.o_orderdate)),
added AS (SELECT (SELECT max(uid) FROM stored) + row_number() OVER (ORDER BY o_custkey, o_orderdate) AS uid,
    o_custkey, price FROM fresh)
"""


def _stored_and_batch(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", *_KEY, F.col("o_totalprice").alias("price"))
    batch = orders.select(*_KEY, "price", F.col("o_orderkey").alias("seq"))
    finished = orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "uid")
    stored = upserts.first_write(finished, _KEY, "uid").select("uid", *_KEY, "price")
    return stored, batch


@query(
    "upsert_first",
    _UPSERT_SQL.format(way="ASC") + "SELECT uid, o_custkey, price FROM stored UNION ALL SELECT * FROM added",
)
def upsert_first(spark, sf_dir):
    stored, batch = _stored_and_batch(spark, sf_dir)
    return upserts.insert_first(stored, batch, _KEY, "seq", "uid").select("uid", "o_custkey", "price")


@query(
    "upsert_last",
    _UPSERT_SQL.format(way="DESC")
    + "SELECT s.uid, s.o_custkey, b.price FROM stored s JOIN batch b USING (o_custkey, o_orderdate) "
    "UNION ALL SELECT * FROM added",
)
def upsert_last(spark, sf_dir):
    stored, batch = _stored_and_batch(spark, sf_dir)
    return upserts.upsert_last(stored, batch, _KEY, "seq", ["price"], "uid").select("uid", "o_custkey", "price")


@query(
    "surrogate_key",
    "SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS uid FROM customer",
)
def surrogate_key(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return upserts.assign_uids(customers, ["c_name", "c_custkey"], "uid", 1000).select("c_custkey", "uid")


@query(
    "update_split",
    view_sql("samples") + "SELECT weather_uid, CASE WHEN weather = 'Fog' THEN 'testing' ELSE split END AS split FROM samples",
)
def update_split(spark, sf_dir):
    samples = view(spark, sf_dir, "samples").select("weather_uid", "split")
    updates = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(
        F.col("o_orderkey").alias("weather_uid"), F.lit("testing").alias("split")
    )
    return upserts.update_column(samples, updates, "weather_uid", "split")


@query(
    "scene_order",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations",
)
def scene_order(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return ranked(turns, ["conv_id"], [F.col("turn")], "position")


@query(
    "sensor_order",
    "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag "
    "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem",
)
def sensor_order(spark, sf_dir):
    """Positions in three groups that each hold a third of the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return ranked(lines, ["l_returnflag"], order).drop("l_suppkey")


@query(
    "pk_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def pk_violations(spark, sf_dir):
    return integrity.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "fk_violations",
    "SELECT source_doc AS doc_id, count(*) AS n_rows FROM (SELECT doc_id AS source_doc FROM documents) "
    "WHERE source_doc NOT IN (SELECT doc_id FROM labels) GROUP BY ALL",
)
def fk_violations(spark, sf_dir):
    """Documents without labels, as if documents referred to labels."""
    fk = ForeignKey("documents", ("doc_id",), "labels", ("doc_id",))
    tables = {name: table(spark, sf_dir, name).select("doc_id") for name in ("documents", "labels")}
    return integrity.orphans(Catalog(tables, {}, [fk]), fk)


@query(
    "null_violations",
    view_sql("frames") + "SELECT 'custom' AS column_name, count(*) AS n_null FROM frames WHERE custom IS NULL",
)
def null_violations(spark, sf_dir):
    frames = view(spark, sf_dir, "frames")
    return integrity.null_counts(frames, frames.columns)


_GONE = """
WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')),
c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
"""
_LEFT = {
    "region": "r_name <> 'ASIA'",
    "nation": "n_nationkey NOT IN (FROM n)",
    "customer": "c_custkey NOT IN (FROM c)",
    "supplier": "s_suppkey NOT IN (FROM s)",
    "part": "true",
    "orders": "o_orderkey NOT IN (FROM o)",
    "lineitem": "l_orderkey NOT IN (FROM o) AND l_suppkey NOT IN (FROM s)",
    "events": "user_id NOT IN (FROM c)",
    "documents": "true",
    "labels": "true",
}


@query(
    "cascade_delete",
    _GONE
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t} WHERE {w}" for t, w in _LEFT.items()),
)
def cascade_delete(spark, sf_dir):
    """Rows left per table after deleting one region and everything below it."""
    catalog = star(spark, sf_dir)
    doomed = catalog.table("region").where("r_name = 'ASIA'").select("r_regionkey")
    left = integrity.cascade_delete(catalog, "region", doomed)
    return reduce(
        DataFrame.unionAll,
        [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in left.items()],
    )


@query(
    "cascade_update",
    "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) "
    "SELECT c_custkey, (CASE WHEN c_nationkey IN (FROM n) THEN c_nationkey + 100 ELSE c_nationkey END)::INT AS c_nationkey "
    "FROM customer",
)
def cascade_update(spark, sf_dir):
    """Customers after the nations of one region got new keys."""
    catalog = star(spark, sf_dir)
    nations = catalog.table("nation").where("n_regionkey = 2")
    changes = nations.select("n_nationkey", (F.col("n_nationkey") + 100).alias("new_n_nationkey"))
    return integrity.cascade_update(catalog, "nation", changes)["customer"].select("c_custkey", "c_nationkey")


@query(
    "upsert_ties",
    "WITH b AS (SELECT user_id, event_id % 50 AS seq, event_type, value FROM events), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, event_type, value) AS rn FROM b) "
    "SELECT c_custkey AS user_id, CASE WHEN rn IS NULL THEN c_mktsegment ELSE event_type END AS event_type "
    "FROM customer LEFT JOIN r ON user_id = c_custkey AND rn = 1 "
    "UNION ALL SELECT user_id, event_type FROM r WHERE rn = 1 AND user_id NOT IN (SELECT c_custkey FROM customer)",
)
def upsert_ties(spark, sf_dir):
    """Keys repeated in the batch, most of them with equal sequence numbers."""
    batch = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("seq"), "event_type", "value")
    stored = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type")
    )
    return upserts.upsert_last(stored, batch, ["user_id"], "seq", ["event_type"])


@query(
    "cascade_rows",
    _GONE + f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {_LEFT['lineitem']}",
)
def cascade_rows(spark, sf_dir):
    catalog = Catalog(
        {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")},
        STAR_TABLES,
        [ForeignKey(c, (cc,), p, (pc,)) for c, cc, p, pc in STAR_KEYS],
    )
    doomed = catalog.table("region").where("r_name = 'ASIA'").select("r_regionkey")
    return integrity.cascade_delete(catalog, "region", doomed)["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
