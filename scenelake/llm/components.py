"""Connected components of an edge table, by alternating large and small stars.

Each round rewires edges to the smallest neighbour (first from larger
neighbours, then from smaller ones) until every component is a star around its
smallest node; that takes about log² rounds. Edges live in the shared
checkpoint folder between rounds; the driver sees only their count and a
checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.session import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of long nodes; gives (node, root) for every node of an edge but the roots themselves."""
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(nearest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        after = materialise(
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        seen, mark = mark, _mark(after)
        now = after
        if mark == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
