"""Substring de-duplication by level-wise doubling.

Asked for windows of ``window`` words, the lengths double from ``ceil(window /
2**k)`` (7 for 13) up to it. Only windows that hold a repeated window of the
length before are looked at on the next level, so each level sees fewer texts
than the one before; when no window is repeated any more, nothing is left to
do. A repeated window repeats all of its parts, so it is enough to follow one
part: the one with the smallest hash (its minimizer). Neighbouring windows
share minimizers, which makes the first level about a quarter of the words.

A level counts hashes in a shuffle that carries one row per hash and flush of
a task (a hash in two documents of a flush is known to be repeated, but still
one or two rows), so frequent passages are aggregated before they move.
Repeated hashes enter a bitmap of fixed size (``BITS``), which is broadcast; it
lets through every repeated hash and some others, which only cost work. The
last level is exact: of equal windows in a flush all but those of the smallest
doc_id are settled at once, the others meet by hash.

Texts without a candidate are finished in the scan that finds that out; the
others are written to the shared folder once, as their removal lists come back
by document.

Windows are compared by 64-bit hashes of their words' 64-bit hashes.

Defined cases: a null or empty text has no words; texts shorter than the window
stay whole; a null doc_id counts as larger than any other; rows of one doc_id
never remove each other's words; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import working_folder, whole
from scenelake.session import materialise

WINDOW = 13
BASE = 8  # the first level is at most this long
BITS = 1 << 28  # bitmap of repeated hashes: 32 MB whatever the input
FLUSH = 1_000_000  # entries a task gathers before it aggregates them
SLICE = 4 << 20  # bytes whose words are hashed at once
LAST = (1 << 63) - 1  # stands for a null doc_id

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def lengths(window: int, base: int = BASE) -> list[int]:
    """Window lengths of the levels, each at most twice the one before."""
    out = [window]
    while out[0] > base:
        out.insert(0, (out[0] + 1) // 2)
    return out


# --- hashing -------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _letters(letter: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number of its own for every letter at every place; no sum of them is bound to another's by a rule."""
    return _mix(_mix(place.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0xC2B2AE3D27D4EB4F)) + letter.astype(_U))


_NEAR = 64  # places whose numbers are looked up; those further on are computed
_TABLE = _letters(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


class Words:
    """Words of a batch of texts: where they are, what they hash to, which text they are in."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        buffers = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]] if len(texts) else raw[:0]
        offsets = offsets - offsets[0]
        inside = ~_BLANK[self.data]
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        before[edges], after[edges - 1] = False, False
        self.start = np.flatnonzero(inside & ~before[: len(inside)])
        self.end = np.flatnonzero(inside & ~after[: len(inside)]) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.hash = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start), _U)
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + SLICE)))
            a, b = self.start[at], self.end[to - 1]
            size = self.end[at:to] - self.start[at:to]
            letters = self.data[a:b][inside[a:b]]
            first = np.cumsum(size) - size
            place = np.arange(len(letters)) - np.repeat(first, size)
            if size.max() <= _NEAR:
                terms = _TABLE[(place << 8) | letters]
            else:
                terms = _TABLE[(np.minimum(place, _NEAR - 1) << 8) | letters]
                far = np.flatnonzero(place >= _NEAR)
                terms[far] = _letters(letters[far], place[far])
            out[at:to] = _mix(np.add.reduceat(terms, first) ^ (size.astype(_U) * _U(0xC2B2AE3D27D4EB4F)))
            at = to
        return out

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, for all words but the batch's last n - 1."""
        m = max(0, len(self.hash) - n + 1)
        out = np.zeros(m, _U)
        for i in range(n):
            out = out * _U(0x9FB21C651E98DF25) + self.hash[i : i + m]
        return _mix(out)

    def whole_windows(self, n: int) -> np.ndarray:
        """First words of the windows of n words that lie in one text."""
        m = max(0, len(self.hash) - n + 1)
        return np.flatnonzero(self.doc[:m] == self.doc[n - 1 : n - 1 + m])


def smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of n neighbouring values, by doubling the covered width."""
    if len(values) < n:
        return values[:0]
    width = 1
    while width < n:
        step = min(width, n - width)
        values = np.minimum(values[: len(values) - step], values[step:])
        width += step
    return values


class Bitmap:
    """Two bits per hash in a bitmap of ``BITS``."""

    def __init__(self, words: bytes):
        self.words = np.frombuffer(words, np.uint8)

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = _U(8 * len(self.words) - 1)
        return (h >> _U(2)) & bits, (h >> _U(33)) & bits

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for s in self.slots(h):
            out &= (self.words[(s >> _U(3)).astype(np.int64)] >> (s & _U(7)).astype(np.uint8)) & 1 == 1
        return out


def candidates(words: Words, levels: list[int], bitmaps: list[Bitmap]) -> np.ndarray:
    """First words of the windows of the next level whose followed part is repeated."""
    longer = levels[len(bitmaps)]
    at = words.whole_windows(longer)
    if not bitmaps or not len(at):
        return at
    shorter = levels[len(bitmaps) - 1]
    return at[bitmaps[-1].has(smallest(words.windows(shorter), longer - shorter + 1)[at])]


# --- counting a level ----------------------------------------------------------------------------------------------


def _flushed(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Each hash once with its smallest doc_id, and once more with its largest where that differs."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(h) else np.zeros(0, bool)
    low, high = doc[new], doc[last]
    twice = low != high
    out_h = np.concatenate([h[new], h[new][twice]]).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(out_h), pa.array(np.concatenate([low, high[twice]]))], names=["h", "doc"]
    )


def _level(levels: list[int], shared: list):
    """Followed parts of this level's windows (those that the next level would need), hashed."""
    k = len(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [Bitmap(s.value) for s in shared]
        held_h, held_d, size = [], [], 0
        for batch in batches:
            words = Words(batch.column("text"))
            ids = batch.column("doc").to_numpy()
            this, following = levels[k], levels[k + 1]
            at = words.whole_windows(following)
            if not len(at):
                continue
            h = words.windows(this)
            if bitmaps:
                # A window of this level counts only if its own followed part was repeated.
                good = np.zeros(len(h), bool)
                good[candidates(words, levels, bitmaps)] = True
            part = smallest(h, following - this + 1)[at]
            change = np.concatenate([[True], (part[1:] != part[:-1]) | (words.doc[at][1:] != words.doc[at][:-1])])
            part, doc = part[change], ids[words.doc[at[change]]]
            if bitmaps:
                known = np.isin(part, h[good])
                part, doc = part[known], doc[known]
            held_h.append(part)
            held_d.append(doc)
            size += len(part)
            if size >= FLUSH:
                yield _flushed(np.concatenate(held_h), np.concatenate(held_d))
                held_h, held_d, size = [], [], 0
        if size:
            yield _flushed(np.concatenate(held_h), np.concatenate(held_d))

    return run


def repeated(texts: DataFrame, levels: list[int], shared: list) -> DataFrame:
    """Hashes of this level that occur in two documents."""
    return (
        texts.mapInArrow(_level(levels, shared), "h long, doc long")
        .groupBy("h")
        .agg(F.min("doc").alias("_low"), F.max("doc").alias("_high"))
        .where("_low < _high")
        .select("h")
    )


def bitmap_of(hashes: DataFrame) -> bytes | None:
    """The bitmap of a level, or None if nothing was repeated."""
    h = F.col("h")
    bit = F.explode(
        F.array(*[F.shiftrightunsigned(h, n).bitwiseAND(F.lit(BITS - 1)) for n in (2, 33)])
    )
    rows = (
        hashes.select(bit.alias("b"))
        .groupBy(F.shiftright("b", 15).alias("block"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b + 1))").alias("bits"))
        .collect()  # at most BITS / 32768 rows of 4 KB
    )
    if not rows:
        return None
    out = bytearray(BITS // 8)
    for row in rows:
        out[row["block"] * 4096 : row["block"] * 4096 + 4096] = row["bits"]
    return bytes(out)


# --- the last level ------------------------------------------------------------------------------------------------


def _sifted(levels: list[int], shared: list):
    """One row per document: finished where no candidate is left, else with its words for the last level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [Bitmap(s.value) for s in shared]
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            words = Words(batch.column("text"))
            n = np.diff(words.first)
            hit = np.zeros(len(n), bool)
            if len(bitmaps) == len(levels) - 1:
                hit[words.doc[candidates(words, levels, bitmaps)]] = True
            raw = words.data.tobytes()
            sha, text = [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                own = b" ".join(raw[words.start[a] : words.end[b - 1]].split()) if b > a else b""
                sha.append(None if hit[i] else hashlib.sha256(own).hexdigest())
                text.append(own.decode() if hit[i] else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(len(n))),
                    batch.column("doc_id"),
                    batch.column("doc"),
                    pa.array(n.astype(np.int64)),
                    pa.array(sha, pa.string()),
                    pa.array(text, pa.string()),
                ],
                names=["rid", "doc_id", "doc", "n_words", "sha", "text"],
            )
            number += len(n)

    return run


def _last_level(levels: list[int], shared: list):
    """Windows to settle: (h, doc, rid, pos, sure); sure ones are known to stand in a smaller doc_id."""

    def settle(h, doc, rid, pos) -> pa.RecordBatch:
        order = np.lexsort((doc, h))
        h, doc, rid, pos = h[order], doc[order], rid[order], pos[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        low = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        sure = doc > low
        # Settled windows need no meeting; a key of their own spreads them.
        h = np.where(sure, _mix(rid.astype(_U) * _U(31) + pos.astype(_U)), h)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(doc), pa.array(rid), pa.array(pos.astype(np.int32)), pa.array(sure)],
            names=["h", "doc", "rid", "pos", "sure"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [Bitmap(s.value) for s in shared]
        held, size = [], 0
        for batch in batches:
            words = Words(batch.column("text"))
            at = candidates(words, levels, bitmaps)
            if not len(at):
                continue
            doc = words.doc[at]
            held.append(
                (
                    words.windows(levels[-1])[at],
                    batch.column("doc").to_numpy()[doc],
                    batch.column("rid").to_numpy()[doc],
                    at - words.first[doc],
                )
            )
            size += len(at)
            if size >= FLUSH:
                yield settle(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield settle(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _cut(window: int):
    """What is left of the documents with removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                words = text.split(" ")
                starts = np.bincount(np.array(at or [], np.int64), minlength=len(words))
                cover = np.cumsum(starts)
                cover[window:] -= cover[:-window].copy()
                gone = cover > 0
                removed.append(int(gone.sum()))
                kept.append(" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept)],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished levels.

    It does so once nothing refers to them; frames of finished jobs may wait for Python's and the JVM's collectors.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _settled(documents: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(finished documents, documents with words to remove: text and the starts of removed windows)."""
    spark = documents.sparkSession
    levels = lengths(window)
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        whole("text").alias("text"),
    )
    shared = []
    for _ in levels[:-1]:
        bits = bitmap_of(repeated(texts.select("doc", "text"), levels, shared))
        _release(spark)
        if bits is None:
            break
        shared.append(spark.sparkContext.broadcast(bits))
    folder = working_folder(spark, "substrings")
    texts.mapInArrow(
        _sifted(levels, shared), "rid long, doc_id long, doc long, n_words long, sha string, text string"
    ).write.option("compression", "zstd").parquet(folder)
    sifted = spark.read.parquet(folder)
    clean = sifted.where("text IS NULL").select("doc_id", "n_words", "sha")
    hit = sifted.where("text IS NOT NULL")
    if len(shared) < len(levels) - 1:
        return clean, hit.select("doc_id", "n_words", "text", F.array().cast("array<int>").alias("at"))
    windows = hit.select("rid", "doc", "text").mapInArrow(
        _last_level(levels, shared), "h long, doc long, rid long, pos int, sure boolean"
    )
    equal = Window.partitionBy("h")
    gone = materialise(
        windows.withColumn("_low", F.min("doc").over(equal))
        .where("sure OR _low < doc")
        .select("rid", "pos")
        .repartition("rid")
        .groupBy("rid")
        .agg(F.collect_list("pos").alias("at"))
    )
    _release(spark)
    return clean, hit.join(gone, "rid", "left").select("doc_id", "n_words", "text", "at")


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the text that is left (words joined by one blank), for every document.

    Documents without a removed word have a null ``kept`` and their digest in ``kept_sha256``.
    """
    clean, cut = _settled(documents, window)
    removed = cut.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
    return removed.withColumn("kept_sha256", F.sha2("kept", 256)).unionByName(
        clean.select(
            "doc_id",
            "n_words",
            F.lit(0).cast("long").alias("n_removed"),
            F.lit(None).cast("string").alias("kept"),
            F.col("sha").alias("kept_sha256"),
        )
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS doc, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
p AS (SELECT rid, doc, unnest(range(1, len(w) - 11)) AS b, w FROM d WHERE len(w) >= 13),
g AS (SELECT rid, doc, b, array_to_string(w[b:b + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc) AS low FROM g GROUP BY s),
f AS (SELECT DISTINCT g.rid, g.b + i AS pos FROM g JOIN m USING (s), range(13) t(i) WHERE m.low < g.doc),
a AS (SELECT rid, list(pos) AS gone FROM f GROUP BY rid),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
             list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
      FROM d LEFT JOIN a USING (rid))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
