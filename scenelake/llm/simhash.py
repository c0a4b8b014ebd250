"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into three blocks. Of at most four differing bits, two of
the blocks hold at most two, so three tables (one per pair of blocks) see
every link. In a table the anchors are the words of a product code: each block
is covered by the binary Golay code of length 23, a perfect code of covering
radius 3. A fingerprint has exactly one anchor within the covering radius in
both blocks: its own. It is replicated to all anchors within the radius plus
what the threshold leaves to each block (3 + i and 3 + j bits, i + j at most
2), about 60 a table, so it meets the own anchor of every fingerprint it may
link to. Fingerprints are compared per anchor, own ones against replicas; the
join passes on linked pairs only. With 2**24 anchors a table an anchor holds
few fingerprints, and the work per fingerprint stays even.

Only different fingerprints are replicated, with the smallest doc_id of each;
copies of a text share one. Components are built on fingerprints.

Defined cases: a null or empty text has fingerprint 0, linked like any other; a
null doc_id gets a component but never names it (a component of null
doc_ids only is null); repeated rows give repeated results; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import whole
from scenelake.llm.components import components
from scenelake.session import materialise

SHINGLE = 4
THRESHOLD = 4
HASH_SEED = 42
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit and width
PAIRS = ((0, 1), (0, 2), (1, 2))
BUDGET = 2  # differing bits that some pair of blocks does not exceed
RADIUS = 3
LENGTH, CHECKS = 23, 11
GENERATOR = 0b110001110101  # of the binary Golay code
ROWS = 4096  # fingerprints replicated at once


# --- fingerprints --------------------------------------------------------------------------------------------------


def fingerprint_batch(texts: list[str], shingle: int = SHINGLE, seed: int = HASH_SEED) -> np.ndarray:
    """64-bit fingerprints of whole texts."""
    import xxhash

    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.encode().lower().split()
        if not words:
            counts.append(0)
            continue
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        ends = (ends - 1).tolist()
        n = max(1, len(words) - shingle + 1)
        last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
        hashes += [digest(flat[a:b], seed) for a, b in zip(starts[:n], last, strict=True)]
        counts.append(n)
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    values = np.array(hashes, np.uint64)
    ones = np.zeros((len(full), 64), np.int64)
    # A few thousand shingles at a time: their bits take 64 bytes each.
    owner = np.repeat(np.arange(len(full)), counts[full])
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = owner[at : at + len(part)]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    major = ones * 2 > counts[full][:, None]
    out[full] = (major.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = fingerprint_batch(batch.column("text").to_pylist())
        rest = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(fps.view(np.int64))], names=[*rest, "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


# --- anchors -------------------------------------------------------------------------------------------------------


def syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = values.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECKS))
    return rest


class Covering:
    """For every syndrome the error patterns up to weight 5: xor with a word gives the code words near it."""

    def __init__(self):
        from itertools import combinations

        patterns, weights = [], []
        for w in range(RADIUS + BUDGET + 1):
            for at in combinations(range(LENGTH), w):
                patterns.append(sum(1 << i for i in at))
                weights.append(w)
        patterns, weights = np.array(patterns), np.array(weights)
        of = syndromes(patterns)
        order = np.lexsort((weights, of))
        self.patterns, self.over = patterns[order], np.maximum(0, weights[order] - RADIUS)
        bounds = np.searchsorted(of[order], np.arange((1 << CHECKS) + 1))
        self.first, self.count = bounds[:-1], np.diff(bounds)

    def own(self, block: np.ndarray) -> np.ndarray:
        """The anchor within the covering radius, as 12 information bits."""
        return (block ^ self.patterns[self.first[syndromes(block)]]) >> CHECKS

    def near(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, bits beyond the radius) of all anchors within radius plus budget."""
        s = syndromes(block)
        n = self.count[s]
        row = np.repeat(np.arange(len(block)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[s][row]
        return row, (block[row] ^ self.patterns[at]) >> CHECKS, self.over[at]


_COVER: list[Covering] = []


def covering() -> Covering:
    if not _COVER:
        _COVER.append(Covering())
    return _COVER[0]


def blocks_of(fps: np.ndarray) -> list[np.ndarray]:
    raw = fps.view(np.uint64)
    return [((raw >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in BLOCKS]


def own_anchors(fps: np.ndarray) -> list[np.ndarray]:
    """Anchor key per table of each fingerprint."""
    own = [covering().own(b) for b in blocks_of(fps)]
    return [(t << 24) | (own[i] << 12) | own[j] for t, (i, j) in enumerate(PAIRS)]


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor key) of every anchor a fingerprint is replicated to."""
    near = [covering().near(b) for b in blocks_of(fps)]
    rows, keys = [], []
    for t, (i, j) in enumerate(PAIRS):
        (ri, ai, oi), (rj, aj, oj) = near[i], near[j]
        nj = np.bincount(rj, minlength=len(fps))
        firsts = np.cumsum(nj) - nj
        # Each anchor of the one block with each of the other, of one fingerprint.
        n = nj[ri]
        left = np.repeat(np.arange(len(ri)), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + firsts[ri][left]
        keep = oi[left] + oj[right] <= BUDGET
        left, right = left[keep], right[keep]
        rows.append(ri[left])
        keys.append((t << 24) | (ai[left] << 12) | aj[right])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches, make):
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for at in range(0, len(fps), ROWS):
            row, key = make(fps[at : at + ROWS])
            # The spread replicas leave in pieces of bounded size.
            for a in range(0, len(row), 1 << 17):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a : a + (1 << 17)].astype(np.int32)), pa.array(fps[at : at + ROWS][row[a : a + (1 << 17)]])],
                    names=["anchor", "fp"],
                )


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(fps):
        keys = own_anchors(fps)
        return np.tile(np.arange(len(fps)), len(keys)), np.concatenate(keys)

    return _keys(batches, make)


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keys(batches, replicas)


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of different fingerprints (column ``fp``, each once) that differ in at most ``threshold`` bits.

    Complete up to a threshold of 4. A link may be listed once per table.
    """
    if threshold > THRESHOLD:
        raise ValueError("the covering is laid out for at most four differing bits")
    # Each row becomes about 185, so they are dealt out by number, not by their own small size.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    own = fps.mapInArrow(_own, "anchor int, fp long").withColumnRenamed("fp", "a")
    spread = fps.mapInArrow(_replicated, "anchor int, fp long").withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return spread.join(own.hint("shuffle_hash"), (spread["anchor"] == own["anchor"]) & close).select("a", "b")


def _grouped(stamped: DataFrame) -> DataFrame:
    """``stamped`` (doc_id, fp and more) with ``_root``, one fingerprint of the component, component_id and n_links."""
    distinct = materialise(stamped.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    pairs = materialise(links(distinct.select("fp")).distinct())
    degree = (
        pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .groupBy(F.col("a").alias("_a"))
        .agg(F.count("*").alias("_links"))
    )
    found = components(pairs)
    # Roots of stars do not list themselves; they and lone fingerprints are their own root.
    rooted = (
        distinct.join(found, distinct["fp"] == found["node"], "left")
        .select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    )
    names = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = (
        rooted.join(names, "_root")
        .join(degree, F.col("fp") == F.col("_a"), "left")
        .select(F.col("fp").alias("_fp"), "_root", "component_id", F.coalesce("_links", F.lit(0)).alias("n_links"))
    )
    return stamped.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, n_links (other fingerprints linked to the document's own)."""
    return _grouped(materialise(fingerprints(documents))).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "n_links",
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row per component, with all columns: one that names it, or any where all doc_ids are null.

    Rows of one doc_id are told apart by a hash of their text, so each counts in its own component. Of several rows
    that could stay the one with the smallest hash does.
    """
    own = lambda text: F.xxhash64(whole(text))
    stamped = materialise(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), own("text").alias("_own"), whole("text").alias("text")
        ).mapInArrow(_fingerprints, "doc_id long, _own long, fp long")
    )
    stay = (
        _grouped(stamped)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("_root", F.col("doc_id").alias("_id"))
        .agg(F.min("_own").alias("_least"))
    )
    packed = documents.select(
        F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_doc_id"), own("text").alias("_key")
    )
    same = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_least"))
    # Repeated rows of the one that stays.
    one = Window.partitionBy("_doc_id", "_key").orderBy("_key")
    return (
        packed.join(stay, same, "left_semi")
        .withColumn("_rn", F.row_number().over(one))
        .where("_rn = 1")
        .select("_doc.*")
    )
