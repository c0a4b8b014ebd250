"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they agree after all ASCII blanks are deleted; a SHA-256
of what is left stands for the text. A Misra-Gries summary names the digests
that may be frequent. Those are counted exactly, and their winners (at most as
many rows as the summary has counters) are broadcast, so a frequent text never
enters a shuffle row by row. All other digests share an ordinary shuffle in
which no group exceeds ``1 / counters`` of the rows.

Defined cases: a null text is an empty one; null doc_ids lose to any other;
of rows that agree in length and doc_id one arbitrary row stays; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import BLANKS, whole
from scenelake.session import materialise

COUNTERS = 4096
SUMMARY_GROUPS = 64  # first-level merges of the per-task summaries


def digest(text: Column | str) -> Column:
    """SHA-256 (binary) of a text without its blanks."""
    return F.unhex(F.sha2(F.regexp_replace(whole(text), BLANKS, ""), 256))


def frequent_digests(narrow: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` hashes; every digest on more than ``1 / counters`` of the rows is among them.

    The frequent-items sketch of Spark's ``approx_top_k`` is a Misra-Gries
    summary. Tasks summarise, groups of tasks merge, one small row remains.
    """
    return (
        narrow.select(F.xxhash64("_digest").alias("h"))
        .groupBy((F.spark_partition_id() % SUMMARY_GROUPS).alias("g"))
        .agg(F.expr(f"approx_top_k_accumulate(h, {counters})").alias("s"), F.count("*").alias("n"))
        # Grouped, as partitions without a row have no summary to merge.
        .groupBy((F.col("g") * 0).alias("g"))
        .agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s"), F.sum("n").alias("n"))
        .select("n", F.explode(F.expr(f"approx_top_k_estimate(s, {counters})")).alias("x"))
        .where(F.col("x.count") * counters > F.col("n"))
        .select(F.col("x.item").alias("_h"))
    )


def exact_groups(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points in its original text stays, then the
    smallest doc_id.
    """
    narrow = materialise(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.char_length(whole("text")).alias("_n"),
            digest("text").alias("_digest"),
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    # Bitwise NOT reverses the order of integers; in max() a null key loses.
    claim = F.struct(F.col("_n").alias("n"), F.bitwise_not("doc_id").alias("d"), F.bitwise_not("_row").alias("r"))

    def result(df: DataFrame) -> DataFrame:
        return df.select(
            "doc_id",
            F.bitwise_not("_best.d").alias("keep_id"),
            F.col("_size").alias("group_size"),
            (F.col("_best.r") == F.bitwise_not("_row")).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )

    candidates = materialise(frequent_digests(narrow, counters))
    winners = materialise(
        narrow.join(F.broadcast(candidates), F.xxhash64("_digest") == F.col("_h"), "left_semi")
        .groupBy("_digest")
        .agg(F.max(claim).alias("_best"), F.count("*").alias("_size"))
    )
    heavy = narrow.join(F.broadcast(winners), "_digest")
    group = Window.partitionBy("_digest")
    rest = (
        narrow.join(F.broadcast(winners), "_digest", "left_anti")
        .withColumn("_best", F.max(claim).over(group))
        .withColumn("_size", F.count("*").over(group))
    )
    return result(heavy).unionByName(result(rest))


def drop_copies(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that repeat another one's doc_id and text count as one document.
    """
    groups = exact_groups(documents, counters)
    stay = groups.where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    packed = documents.select(
        F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_doc_id"), digest("text").alias("_key")
    )
    same = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_sha"))
    # One row per (doc_id, text), the longest: the row limit of a first-row window runs before its shuffle.
    one = Window.partitionBy("_doc_id", "_key").orderBy(F.char_length(whole("_doc.text")).desc())
    return (
        packed.join(stay, same, "left_semi")
        .withColumn("_rn", F.row_number().over(one))
        .where("_rn = 1")
        .select("_doc.*")
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM t
"""
