"""Query registry and the views that give the given tables the shape of driving scenes.

A view is a table plus named SQL expressions, written once and used both by
Spark (``selectExpr``) and in the oracle text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from scenelake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Schemas read so far; a stored catalog knows them, so a file is opened for its schema only once.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    reader = configure(spark).read
    if path not in _SCHEMAS:
        _SCHEMAS[path] = reader.parquet(path).schema
    return reader.schema(_SCHEMAS[path]).parquet(path)


# The places with known coordinates.
PLACES = {
    "boston-seaport": (42.336849169438615, -71.05785369873047),
    "singapore-onenorth": (1.2882100868743724, 103.78475189208984),
    "singapore-hollandvillage": (1.2993652317780957, 103.78217697143555),
    "singapore-queenstown": (1.2782562240223188, 103.76741409301758),
    "location_sf": (37.773972, -122.431297),
    "location_phx": (33.448376, -112.074036),
}


def place(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLACES))
    return f"CASE {key} % {len(PLACES)} {whens} END"


# view: (base table, row filter, columns)
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    # One sample per order.
    "samples": (
        "orders",
        "true",
        {
            "weather_uid": "o_orderkey",
            "time": "o_orderdate",
            "location": place("o_custkey"),
            "tod": "CASE o_orderstatus WHEN 'O' THEN 'Day' WHEN 'F' THEN 'night' ELSE 'Dawn/Dusk' END",
            "weather": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Clear Sky' WHEN '2-HIGH' THEN 'Light Rain' "
            "WHEN '3-MEDIUM' THEN 'Overcast' WHEN '4-NOT SPECIFIED' THEN 'Light Snow' ELSE 'Fog' END",
            "split": "CASE WHEN o_orderkey % 10 < 7 THEN 'training' WHEN o_orderkey % 10 < 9 THEN 'validation' "
            "ELSE 'testing' END",
            "dataset": "CASE o_orderkey % 3 WHEN 0 THEN 'waymo' WHEN 1 THEN 'nuscenes' ELSE 'nuimages' END",
            "price": "o_totalprice",
        },
    ),
    # Open lines are camera frames, finished lines lidar sweeps of their order's sample.
    "cameras": (
        "lineitem",
        "l_linestatus = 'O'",
        {
            "camera_uid": "(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey",
            "weather_uid": "l_orderkey",
            "camera_id": "concat('cam_', l_linenumber)",
            "quantity": "l_quantity",
            "price": "l_extendedprice",
        },
    ),
    "sweeps": (
        "lineitem",
        "l_linestatus = 'F'",
        {
            "lidar_uid": "(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey",
            "weather_uid": "l_orderkey",
            "lidar_id": "concat('lidar_', l_linenumber)",
            "quantity": "l_quantity",
        },
    ),
    "camera_results": (
        "lineitem",
        "l_linestatus = 'O' AND l_returnflag = 'R'",
        {
            "camera_uid": "(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey",
            "iou": "l_discount",
            "ece": "l_tax",
            "model": "concat('model_', l_suppkey % 3)",
        },
    ),
    # One frame per event, for everything that needs exact times.
    "frames": (
        "events",
        "true",
        {
            "weather_uid": "event_id",
            "time": "ts",
            "location": place("user_id"),
            "custom": "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE event_type END",
        },
    ),
    # Error events are the moments a label was given; seq is not in time order.
    "label_events": (
        "events",
        "event_type = 'error'",
        {
            "weather_uid": "event_id",
            "label": "concat('label_', event_id % 5)",
            "seq": "CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END",
            "location": place("user_id"),
            "time": "ts",
        },
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, where, columns = VIEWS[name]
    return table(spark, sf_dir, base).where(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def view_sql(*names: str) -> str:
    """``WITH`` clause defining views for an oracle."""
    parts = []
    for name in names:
        base, where, columns = VIEWS[name]
        selected = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {selected} FROM {base} WHERE {where})")
    return "WITH " + ", ".join(parts) + " "


def rounded(expression: str, digits: int = 4) -> str:
    """SQL rounding without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"
