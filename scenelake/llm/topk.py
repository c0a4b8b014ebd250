"""Exact top-k by inner product over norm buckets.

Vectors are ordered by length (Euclidean norm), longest first, and cut into
buckets of ``BUCKET`` vectors; a bucket travels as one row of packed numbers.
Queries are packed into blocks. The bucket of the longest vectors gives every
query a first threshold (its k-th best score there), which then prunes:

* a bucket whose longest vector times the query's length stays below the
  threshold is skipped. As buckets go by falling length, those that a block
  of queries needs are the first few: blocks and buckets are put into one order
  of lengths, where a block's place tells its last bucket, so that no key but
  the bucket's own brings them together;
* inside a bucket the threshold becomes a local cosine threshold. Where that
  is high, candidates must lie in a narrow range on the query's two heaviest
  coordinates (coordinate pruning); where it is low, only the vectors long
  enough are taken (length pruning).

Surviving candidates are verified by exact integer products. No pair of rows
is ever built; a task holds one bucket and one block at a time.

Components become floor(1024 * x). Sums are exact while they fit 63 bits; a
finite vector so long that its product with itself would not (a length above
some 2.96 million before scaling) fails the job by its vec_id, as it must not be
lost. The session's Arrow settings are as before after a call.

Defined cases: vectors that are null, empty or hold a null or non-finite
component take no part; vectors of different dimension are never compared;
rows with a null vec_id take no part; a row never answers a query of its own
vec_id, so repeated rows do not answer each other; equal query rows share
one answer, different vectors under one vec_id are ranked apart; ties go to the smaller vec_id; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import arrow_rows
from scenelake.plans.ordered import ordered_index
from scenelake.session import materialise

SCALE = 1024
BUCKET = 4096
BLOCK = 256
ARROW_VECTORS = 2000  # single vectors per Arrow batch
PAIRS_AT_ONCE = 8  # bucket and block pairs per Arrow batch
STEEP = 0.3  # local cosine threshold above which coordinates prune better than lengths
_LONGEST = 2.0**63 * (1 - 1e-9)  # squared length below which every sum fits
_SLACK = 1e-9  # rounding of the bounds, relative


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, packed = [], [], [], []
            for vec_id, raw in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if vec_id is None or not raw.is_valid or len(raw.values) == 0 or raw.values.null_count:
                    continue
                x = raw.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                if np.dot(q, q) >= _LONGEST:
                    raise ValueError(f"vector {vec_id} is too long for scores of 63 bits")
                ids.append(vec_id)
                dims.append(len(q))
                norms.append(float(np.sqrt(np.dot(q, q))))
                packed.append(q.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()),
                 pa.array(packed, pa.binary())],
                names=["vec_id", "dim", "norm", "q"],
            )

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, norm and the packed integers of every usable vector."""
    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
        _quantised(scale), "vec_id long, dim int, norm double, q binary"
    )


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row per (dim, key): ids, norms and vectors in one order."""
    each = F.array_sort(F.collect_list(F.struct((-F.col("norm")).alias("m"), "vec_id", "q")))
    return rows.groupBy("dim", key).agg(each.alias("_x")).select(
        "dim",
        key,
        F.col("_x.vec_id").alias(f"{key}_ids"),
        F.transform("_x.m", lambda m: -m).alias(f"{key}_norms"),
        F.col("_x.q").alias(f"{key}_q"),
    )


def _matrix(column, row: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype="<i8") for x in column[row].as_py()])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a · bᵀ in integers; double products are exact below 2**53."""
    bound = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _first_thresholds(k: int):
    """k-th best score of each query in the given bucket; minus infinity where it has fewer."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids = np.array(batch.column("bucket_ids")[i].as_py())
                qids = batch.column("block_ids")[i].as_py()
                s = _products(_matrix(batch.column("block_q"), i), _matrix(batch.column("bucket_q"), i))
                theta = []
                for qid, row in zip(qids, s, strict=True):
                    row = row[ids != qid]
                    theta.append(float(np.partition(row, len(row) - k)[len(row) - k]) if len(row) >= k else -np.inf)
                out.append(theta)
            yield pa.RecordBatch.from_arrays(
                [batch.column("dim"), batch.column("block"), pa.array(out, pa.list_(pa.float64()))],
                names=["dim", "block", "theta"],
            )

    return run


def candidates(q: np.ndarray, norm: float, theta: float, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Positions in a bucket (sorted by falling norm) that may reach ``theta``; never misses one."""
    if not np.isfinite(theta) or theta <= 0 or norm == 0:
        return np.arange(len(norms)) if theta <= 0 or not np.isfinite(theta) else np.arange(0)
    local = theta / (norm * norms[0]) * (1 - _SLACK) if norms[0] > 0 else np.inf
    if local > 1:
        return np.arange(0)
    # Lengths: |q| |p| must reach the threshold; norms fall, so this is a prefix.
    n = int(np.searchsorted(-norms, -theta / norm * (1 - _SLACK), side="right"))
    if local < STEEP:
        return np.arange(n)
    keep = np.arange(n)
    unit = q / norm
    for f in np.argsort(-np.abs(unit))[:2]:
        # A unit vector with cosine at least t to ours has its f-th coordinate in this range.
        width = np.sqrt(max(0.0, (1 - local**2) * (1 - unit[f] ** 2))) + 1e-9
        at = vectors[keep, f] / np.where(norms[keep] > 0, norms[keep], 1)
        # The lower end holds for cosine t, the other may reach 1 where the range covers the query itself.
        low = -1.0 if -unit[f] >= local else unit[f] * local - width
        high = 1.0 if unit[f] >= local else unit[f] * local + width
        keep = keep[(at >= low - 1e-9) & (at <= high + 1e-9)]
    return keep


def _bucket_best(k: int):
    def run(batches):
        for batch in batches:
            out_q, out_n, out_v, out_s = [], [], [], []
            for i in range(batch.num_rows):
                number = batch.column("block")[i].as_py() << 32
                ids = np.array(batch.column("bucket_ids")[i].as_py())
                norms = np.array(batch.column("bucket_norms")[i].as_py())
                vectors = _matrix(batch.column("bucket_q"), i)
                qids = batch.column("block_ids")[i].as_py()
                qnorms = batch.column("block_norms")[i].as_py()
                theta = batch.column("theta")[i].as_py()
                queries = zip(qids, qnorms, theta, _matrix(batch.column("block_q"), i), strict=True)
                for n, (qid, norm, t, q) in enumerate(queries):
                    keep = candidates(q, norm, t, vectors, norms)
                    keep = keep[ids[keep] != qid]
                    if not len(keep):
                        continue
                    scores = _products(q[None, :], vectors[keep])[0]
                    best = _best(scores, ids[keep], k)
                    best = best[scores[best] >= t]
                    out_q += [qid] * len(best)
                    out_n += [number + n] * len(best)
                    out_v += ids[keep][best].tolist()
                    out_s += scores[best].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (out_q, out_n, out_v, out_s)],
                names=["query_id", "number", "vec_id", "score"],
            )

    return run


def _needed(told: DataFrame, buckets: DataFrame) -> DataFrame:
    """dim, block, bucket: the buckets long enough for a query of the block.

    Decided on one length per bucket and one per block. In falling order of
    both, a block stands behind exactly the buckets it needs.
    """
    longest = buckets.select("dim", "bucket", F.element_at("bucket_norms", 1).alias("_length"))
    numbered, _ = ordered_index(longest, [F.col("dim"), F.col("bucket")], "_number")
    # The least length any query of the block can use.
    least = F.transform(
        F.arrays_zip("block_norms", "theta"),
        lambda x: F.when(x["theta"] <= 0, 0.0).otherwise(F.try_divide(x["theta"] * (1 - _SLACK), x["block_norms"])),
    )
    ends = told.select("dim", "block", F.array_min(least).alias("_length"))
    order = [F.col("dim"), F.col("_length").desc(), F.col("bucket").asc_nulls_last(), F.col("block")]
    empty = F.lit(None).cast("long")
    both = longest.withColumn("block", empty).unionByName(ends.withColumn("bucket", empty))
    among_both, _ = ordered_index(both, order, "_at")
    among_blocks, _ = ordered_index(ends.withColumn("bucket", empty), order, "_of_blocks")
    before = among_both.where("block IS NOT NULL").join(among_blocks.select("dim", "block", "_of_blocks"), ["dim", "block"])
    starts = numbered.groupBy("dim").agg(F.min("_number").alias("_start"))
    last = F.col("_at") - F.col("_of_blocks") - 1
    reach = before.join(starts, "dim").where(last >= F.col("_start"))
    pairs = reach.select("dim", "block", F.explode(F.sequence(F.col("_start"), last)).alias("_number"))
    return pairs.join(numbered.select("bucket", "_number"), "_number").select("dim", "block", "bucket")


def top_k(
    vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best rows.

    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    by_norm = [F.col("dim"), F.col("norm").desc(), F.col("vec_id")]
    with arrow_rows(spark, ARROW_VECTORS):
        whole = materialise(quantised(vectors, scale))
    ordered, _ = ordered_index(whole, by_norm, "_pos")
    # A bucket holds one dimension; where two meet, the bucket number is shared but the key is not.
    buckets = materialise(_packed(ordered.withColumn("bucket", F.floor(F.col("_pos") / bucket)), "bucket"))
    chosen, _ = ordered_index(whole.where(is_query).dropDuplicates(["vec_id", "q"]), by_norm, "_pos")
    blocks = materialise(_packed(chosen.withColumn("block", F.floor(F.col("_pos") / block)), "block"))

    # The first bucket of a dimension meets all of its blocks, so it is copied for as many groups of blocks as there are tasks.
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longest = buckets.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    first = buckets.join(longest, ["dim", "bucket"]).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    grouped = blocks.withColumn("_group", (F.col("block") % groups).cast("int"))
    with arrow_rows(spark, PAIRS_AT_ONCE):
        theta = materialise(
            grouped.join(first, ["dim", "_group"])
            .select("dim", "block", "block_ids", "block_q", "bucket_ids", "bucket_q")
            .mapInArrow(_first_thresholds(k), "dim int, block long, theta array<double>")
        )
        told = blocks.join(theta, ["dim", "block"])
        found = materialise(
            _needed(told, buckets)
            .join(told, ["dim", "block"])
            .join(buckets, ["dim", "bucket"])
            .select("block", "block_ids", "block_norms", "block_q", "theta", "bucket_ids", "bucket_norms", "bucket_q")
            .mapInArrow(_bucket_best(k), "query_id long, number long, vec_id long, score long")
        )
    by_query = Window.partitionBy("query_id", "number").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
