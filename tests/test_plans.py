"""Shapes of physical plans that must hold at any scale."""

import os

import pytest

from workload import QUERIES
from workload.registry import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas")
# Decoders and a user's own function are Python by nature.
USES_PYTHON = {"fps", "downsample", "explode_sweeps", "request_decoded", "request_transform", "token_list"}
EAGER = {n for n in QUERIES if n.startswith("stream_")}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert any(node in text for node in PYTHON_NODES) == (name in USES_PYTHON)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["get_field"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)]" in text
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.startswith("struct<l_quantity:double,l_linestatus:string>")


def test_payload_columns_stay_out_of_the_page(spark, monkeypatch):
    import scenelake.plans.query as module

    paged, selection = [], module.Selection
    monkeypatch.setattr(module, "Selection", lambda df, order: paged.append(df.dtypes) or selection(df, order))
    assert "image" in QUERIES["late_payload"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert len(paged) == 1 and not any("array" in kind for _, kind in paged[0])


@pytest.mark.parametrize("name", ["points_in_box", "sibling_fanout", "token_lookup", "upsert_last", "cascade_rows"])
def test_large_sides_are_not_broadcast(spark, name):
    """Without the size check passing, every join has another way."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(QUERIES[name](spark, SF))
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_broadcasts_only_slice_carries(spark):
    from pyspark.sql import functions as F

    from scenelake.plans.ordered import ranked

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = ranked(table(spark, SF, "lineitem").select("l_returnflag", "l_orderkey"), ["l_returnflag"], [F.col("l_orderkey")])
        text = plan(df)
        assert text.count("BroadcastExchange") == 1 and "rowsBetween" not in text
        assert "hashpartitioning(_slice" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_counts_flat_columns_from_footers(spark):
    text = plan(QUERIES["catalog_columns"](spark, SF))
    assert "PushedAggregation: [COUNT(o_orderkey), COUNT(o_custkey)" in text
    assert "PushedAggregation: [COUNT(vec_id)]" in text and "PushedAggregation: [COUNT(vec_id), COUNT(emb" not in text
