"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by weight; a target stops at ``cap``
times its source's size and the excess is shared out again. A source is taken
whole as often as its target allows; the remaining budget is a subset-sum
problem over its documents. That problem only sees how many documents have
which exact length: a first selection spreads the budget evenly over the
lengths, then a bounded-knapsack dynamic program fits what is left (at most
about one document) to the word. Sums above the budget are fitted likewise by
what they leave out, and the nearer of the two counts. The chosen number of documents of each
length are those with the smallest keyed hashes.

Scale: documents are reduced to (source, length) counts before anything is
grouped. The dynamic program runs per source on those counts, so its input
grows with the number of different lengths, not with documents. Documents of
one (source, length) may be any share of the table: they are dealt by their
hash into bins, bins are counted, and only the one bin in which the cut falls
is ordered.

Defined cases: a null text has size 0, and a document of size 0 takes 0; a null
source is a source of its own, last in order; documents with equal doc_id and
size are cut between arbitrarily; if all sizes are 0 all targets are 0; an
empty table gives an empty result; other columns are kept by ``apply_mix``
only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import WORDS, whole
from scenelake.plans.ordered import ordered_index, ranked
from scenelake.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 42
BINS = 1 << 16
BUDGET_BITS = 1 << 20  # widest budget the dynamic program tries to fit; a greedy fill comes closer first
EXACT_BITS = 1 << 26  # a budget times its items, up to which the program sees all documents of a source at once


def size(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORDS)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``totals`` (source, source_size) with the target of each source.

    Rounds of sharing: sources above their cap are set to it and the rest
    shared by weight again. A round is one small aggregate; nothing but its
    two sums reaches the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    numbered, count = ordered_index(totals, order, "_at")
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    numbered = materialise(numbered.withColumn("_weight", weight))
    limit = cap * F.col("source_size").cast("double")
    budget = numbered.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    for _ in range(count + 1):
        # A source stays capped once it was: the rate only grows.
        full = F.lit(rate) * F.col("_weight") > limit
        state = numbered.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)).alias("given"),
            F.sum(F.when(~full, F.col("_weight")).otherwise(0.0)).alias("weight"),
        ).first()
        if state["n"] == capped or not state["weight"]:
            break
        capped, rate = state["n"], (budget - state["given"]) / state["weight"]
    return numbered.select(
        "source", "source_size", F.least(limit, F.lit(rate) * F.col("_weight")).alias("target")
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to choose for a high sum of lengths up to ``budget``.

    ``lengths`` are different and positive. Small problems are solved exactly, others to about one document.
    """
    total = int((lengths * counts).sum())
    chosen = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or total == 0:
        return chosen
    if budget >= total:
        return counts.copy()
    if sum(int(n).bit_length() for n in counts) * budget <= EXACT_BITS:
        return knapsack(lengths, counts, budget)
    # Longest first, each length takes its share and hands the rounding on to the shorter ones.
    order = np.argsort(-lengths)
    share, carried = budget / total, 0.0
    for i in order:
        want = share * counts[i] + carried / lengths[i]
        chosen[i] = min(max(int(np.floor(want)), 0), counts[i])
        carried += (share * counts[i] - chosen[i]) * lengths[i]
    left = budget - int((lengths * chosen).sum())
    # What is left may still be filled with whole documents, longest first.
    for i in order:
        if left <= 0:
            break
        more = min(left // int(lengths[i]), int(counts[i] - chosen[i]))
        chosen[i] += more
        left -= more * int(lengths[i])
    if left == 0:
        return chosen
    # Free some of the smallest chosen documents, so that the program has something to recombine.
    window = left
    for i in order[::-1]:
        if window >= min(4 * int(lengths.max()), BUDGET_BITS // 2):
            break
        back = min(int(chosen[i]), max(1, int(lengths.max()) // int(lengths[i])))
        chosen[i] -= back
        window += back * int(lengths[i])
    return chosen + knapsack(lengths, counts - chosen, window)


def nearest(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to choose so that their lengths sum as near to ``budget`` as they can.

    The lowest sum above the budget is what the highest sum up to the rest of all words leaves out. Of two sums
    equally near the one below counts.
    """
    below = fit(lengths, counts, budget)
    short = budget - int((lengths * below).sum())
    total = int((lengths * counts).sum())
    if short <= 0 or budget >= total:
        return below
    above = counts - fit(lengths, counts, total - budget)
    return above if int((lengths * above).sum()) - budget < short else below


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the highest reachable sum up to ``budget``.

    Reachable sums are the bits of an integer. Counts are split into powers of
    two, and each item's new sums are remembered, which is enough to walk back.
    """
    chosen = np.zeros(len(lengths), dtype=np.int64)
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in np.argsort(lengths):
        length, rest, power = int(lengths[i]), min(int(counts[i]), budget // max(int(lengths[i]), 1)), 1
        while rest > 0 and length * power <= budget:
            take = min(power, rest)
            fresh = (reach << (length * take)) & mask & ~reach
            if fresh:
                steps.append((i, take, fresh))
                reach |= fresh
            rest, power = rest - take, power * 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, take, fresh in reversed(steps):
        if at and fresh >> at & 1:
            chosen[i] += take
            at -= take * int(lengths[i])
    return chosen


def _fit_source(pdf: pd.DataFrame, cap: int = CAP) -> pd.DataFrame:
    """One source's counts by length, with the number to choose of each length once more than the whole copies."""
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    copies = min(int(target // source_size), cap) if source_size else 0
    pdf["copies"] = copies
    pdf["extra"] = nearest(lengths, counts, int(round(target - copies * source_size))) if source_size else 0
    return pdf[["source", "size", "n", "source_size", "target", "copies", "extra"]]


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per (source, size): n documents, copies of each, and how many get one copy more."""
    lengths = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aim = targets(totals, weights, cap).withColumnRenamed("source", "_source")
    told = lengths.join(aim, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "size", "n", "source_size", "target"
    )
    fitted = lambda pdf: _fit_source(pdf, cap)
    schema = "source string, size long, n long, source_size long, target double, copies int, extra long"
    return told.where("size > 0").groupBy("source").applyInPandas(fitted, schema).unionByName(
        # Documents without words belong to the mix, but take nothing.
        told.where("size = 0").select("*", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("extra"))
    )


def mix(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, copies) of every document."""
    sized = materialise(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            size("text").alias("size"),
        ).withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id"))
    )
    lengths = materialise(plan(sized, weights, cap))
    key = ["source", "size"]
    renamed = lengths.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "source_size", "target", "copies", "extra"
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    placed = materialise(
        sized.withColumn("_bin", F.pmod("_draw", F.lit(BINS))).join(renamed, same).drop("_source", "_size")
    )
    # Bins up to the last full one are taken whole; the bin of the cut is ordered; the others wait.
    open_ = placed.where("extra > 0 AND extra < n")
    running = Window.partitionBy(*key).orderBy("_bin")
    fits = F.col("_upto") <= F.col("extra")
    cuts = (
        open_.groupBy(*key, "_bin", "extra")
        .agg(F.count("*").alias("_in"))
        .withColumn("_upto", F.sum("_in").over(running))
        .groupBy(F.col("source").alias("_source"), F.col("size").alias("_size"))
        .agg(
            F.coalesce(F.max(F.when(fits, F.col("_bin"))), F.lit(-1)).alias("_last"),
            F.min(F.when(~fits, F.col("_bin"))).alias("_cut"),
            (F.max("extra") - F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0))).alias("_some"),
        )
    )
    with_cut = open_.join(cuts, same)
    inside = F.col("_bin") == F.col("_cut")
    at_cut = Window.partitionBy(*key).orderBy("_draw", "doc_id")
    split = with_cut.where(inside).withColumn("_more", (F.row_number().over(at_cut) <= F.col("_some")).cast("int"))
    below = with_cut.where(~inside).withColumn("_more", (F.col("_bin") <= F.col("_last")).cast("int"))
    closed = placed.where("extra <= 0 OR extra >= n").withColumn("_more", (F.col("extra") > 0).cast("int"))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("_more")).alias("copies")]
    every = closed.select(*columns).unionByName(below.select(*columns)).unionByName(split.select(*columns))
    return every.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def apply_mix(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """The mixed documents with all their columns; a document taken n times is n rows.

    Rows that share a doc_id, a source and a size share their copies evenly, what is left going to the first of them
    by a hash of their text; they take as many words as in ``mix``.
    """
    chosen = materialise(
        mix(documents, weights, cap, seed)
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
        .agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    )
    packed = documents.select(
        F.struct("*").alias("_doc"),
        F.col("doc_id").cast("long").alias("_doc_id"),
        F.col("source").cast("string").alias("_from"),
        size("text").alias("_own"),
    )
    same = (
        F.col("_doc_id").eqNullSafe(F.col("_id"))
        & F.col("_from").eqNullSafe(F.col("_source"))
        & (F.col("_own") == F.col("_size"))
    )
    each = F.floor(F.col("_all") / F.col("_rows")).cast("int")
    uneven = F.col("_all") % F.col("_rows") != 0
    taken = packed.join(chosen.where(~uneven), same).select("_doc", each.alias("_copies"))
    if not chosen.where(uneven).isEmpty():
        # Few rows as a rule, but without doc_ids a group may be any share of the table.
        numbered = ranked(
            packed.join(chosen.where(uneven), same).select(
                "_doc", "_doc_id", "_source", "_size", "_all", "_rows", F.xxhash64(whole("_doc.text")).alias("_by")
            ),
            ["_doc_id", "_source", "_size"],
            [F.col("_by")],
            "_nth",
        )
        more = (F.col("_nth") <= F.col("_all") % F.col("_rows")).cast("int")
        taken = taken.unionByName(numbered.select("_doc", (each + more).alias("_copies")))
    return taken.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_doc.*")
