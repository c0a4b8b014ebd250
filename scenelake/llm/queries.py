"""The registered queries of the corpus operators, with SQL twins where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import (
    alignment,
    exact_dedup,
    fim,
    language,
    license_scan,
    mixing,
    pieces,
    simhash,
    splitters,
    substrings,
    token_orc,
    topk,
    warc,
)
from scenelake.llm.common import table, working_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_token_orc")
def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_orc.checksums(token_orc.read_tokens(spark, folder))


@query("op2_exact_dedup", exact_dedup.SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op3_merge_dropout")
def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op5_license_scan", license_scan.sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op6_source_mix")
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op7_simhash_anchors")
def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup", substrings.SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op9_warc", warc.SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark, "warc")
    warc.archive_pages(table(spark, sf_dir, "pages"), folder)
    return warc.read_pages(spark, folder)


@query("op10_topk_norms", topk.SQL)
def op10_topk_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_splitter_shards", splitters.SQL)
def op11_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.placements(splitters.shard(table(spark, sf_dir, "documents")))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"))


@query("op13_fill_in_middle", fim.SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.restore(fim.transform(table(spark, sf_dir, "documents"))))
