"""Alignment of two tokenizations of one text: where tokens end together, which overlap, and how often pairs meet.

Both tokenizers spell the same bytes, a blank and the text. The byte offsets
at which their tokens end are two increasing lists. Per document the shorter
one drives a galloping intersection with the longer: from where an earlier
element was found, steps of 1, 2, 4, ... find a stretch that must hold the
next one, and a binary search in that stretch finds it. All elements of a batch search
side by side in numpy; elements whose rank is a multiple of a power of eight
are found first, and each other element starts from the one before it of the
next higher power, so no search begins far from its end. Ends found in both lists
cut the tokens into groups. The number of the other side's ends before a
token's start and before its end are differences of ranks, and give the range
of tokens that it overlaps.

Alignment runs once per document and writes narrow rows: digests, and the
document's distinct linked id pairs with their numbers, one integer a pair.
Corpus counts are an aggregation of those pairs. To bring counts back, the
``FREQUENT`` most frequent pairs are broadcast (a fixed bound, some 3 MB);
they cover most links, so hot pairs enter no join. All other pairs go through an
ordinary join on the pair, of which each document has one row per pair.

Defined cases: null and empty texts, and texts whose tokens do not spell the
blank and the text on both sides, have no tokens, zeros and an empty
groups_sha256; repeated rows and null doc_ids count like any other; very long
texts are aligned whole; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import working_folder
from scenelake.llm.token_orc import Encoder

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
FREQUENT = 1 << 16  # pairs whose counts are broadcast
STRIDE = 8
MARK = "▁"

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<int>"
)


# --- tokens ------------------------------------------------------------------------------------------------------


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as themselves and the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """Ids of one tokenizer, and the bytes, lengths and decimal names of its ids."""

    def __init__(self, spelled: list[bytes]):
        self.size = len(spelled)
        self.spelled = spelled
        self.lengths = np.array([len(x) for x in spelled], np.int64)

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.spelled.__getitem__, ids)) == raw


class ByteLevel(Side):
    """A byte-level BPE of the tokenizers library; special tokens in a text are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, added=False)
        tokenizer, byte = self.encoder.tokenizer, _byte_of_character()
        spelled = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            spelled[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(spelled)

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, counts = self.encoder(pa.array([" " + t for t in texts], pa.string()))
        ids, ends = flat.tolist(), np.cumsum(counts).tolist()
        return [ids[a:b] for a, b in pairwise([0, *ends])]


class PieceModel(Side):
    """A SentencePiece model, which puts the blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__(
            [
                bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace(MARK, " ").encode()
                for i, name in enumerate(names)
            ]
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# --- galloping intersection ----------------------------------------------------------------------------------------


def _gallop_from(values: np.ndarray, wanted: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First index >= ``start`` whose value is at least the wanted one, by growing steps and then halving.

    ``values`` ends with a sentinel above everything wanted.
    """
    last = len(values) - 1
    low, high = start.copy(), start.copy()  # values before low are too small; the answer is at most high
    going = np.flatnonzero(values[high] < wanted)
    step = 1
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, last)
        going = going[values[high[going]] < wanted[going]]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        small = values[middle] < wanted[open_]
        low[open_[small]] = middle[small] + 1
        high[open_[~small]] = middle[~small]
        open_ = open_[low[open_] < high[open_]]
    return high


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each value of an increasing list the number of smaller values in another increasing list."""
    found = np.zeros(len(shorter), np.int64)
    if not len(shorter):
        return found
    values = np.append(longer, np.iinfo(np.int64).max)
    stride = 1
    while stride * STRIDE < len(shorter):
        stride *= STRIDE
    ranks = np.arange(0, len(shorter), stride)
    found[ranks] = _gallop_from(values, shorter[ranks], np.zeros(len(ranks), np.int64))
    while stride > 1:
        coarse, stride = stride, stride // STRIDE
        ranks = np.arange(0, len(shorter), stride)
        ranks = ranks[ranks % coarse != 0]
        found[ranks] = _gallop_from(values, shorter[ranks], found[ranks - ranks % coarse])
    return found


class Alignment:
    """Groups and links of two token lists that spell the same bytes; several documents may follow each other.

    ``ends_a`` and ``ends_b`` increase over all of them and agree at each document's end.
    """

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        self.a_drives = len(ends_a) <= len(ends_b)
        shorter, longer = (ends_a, ends_b) if self.a_drives else (ends_b, ends_a)
        below = gallop(shorter, longer)
        common = longer[np.minimum(below, len(longer) - 1)] == shorter if len(longer) else np.zeros(0, bool)
        driver = np.flatnonzero(common)
        # Ranks of the common ends on both sides.
        self.common_a, self.common_b = (driver, below[driver]) if self.a_drives else (below[driver], driver)
        # A token of the driving side overlaps the other side's tokens from the one that ends after its start ...
        upto = below + common
        self.first = np.concatenate([[0], upto[:-1]]) if len(upto) else upto
        # ... to the one in which it ends.
        self.counts = below - self.first + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all overlapping token pairs (A, B), in order."""
        driver = np.repeat(np.arange(len(self.counts)), self.counts)
        begins = np.cumsum(self.counts) - self.counts
        other = np.arange(len(driver)) + np.repeat(self.first - begins, self.counts)
        return (driver, other) if self.a_drives else (other, driver)


def spelled_groups(alignment: Alignment, a: np.ndarray, b: np.ndarray, names: list[str], size_a: int) -> list[str]:
    """Tokens in the order of the groups, A's before B's, each with the sign that follows it.

    ``names`` holds every id of A with a comma, then with a bar, then every id of B with a comma, then a semicolon.
    """
    size_b = len(names) // 2 - size_a
    code_a, code_b = a.astype(np.int64), b.astype(np.int64) + 2 * size_a
    code_a[alignment.common_a] += size_a
    code_b[alignment.common_b] += size_b
    # A token stands behind its own side's earlier tokens and the other side's tokens of earlier groups (for B also
    # A's of its own group).
    sizes_a = np.diff(alignment.common_a, prepend=-1)
    sizes_b = np.diff(alignment.common_b, prepend=-1)
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = code_a
    out[np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = code_b
    return list(map(names.__getitem__, out.tolist()))


# --- batches -------------------------------------------------------------------------------------------------------


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), PieceModel(path_b)
        self.names = [f"{i}{sign}" for side, signs in ((self.a, ",|"), (self.b, ",;")) for sign in signs for i in range(side.size)]

    def batch(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text."""
        out: list[tuple] = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(texts)
        filled = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in filled]
        spelled = []
        for i, text, ids_a, ids_b in zip(filled, some, self.a.encode(some), self.b.encode(some), strict=True):
            raw = (" " + text).encode()
            if self.a.spells(ids_a, raw) and self.b.spells(ids_b, raw):
                spelled.append((i, np.array(ids_a, np.int32), np.array(ids_b, np.int32)))
        # The shorter list of each document drives.
        for a_shorter in (True, False):
            group = [x for x in spelled if (len(x[1]) <= len(x[2])) == a_shorter]
            for (i, _, _), row in zip(group, self._align(group), strict=True):
                out[i] = row
        return out

    def _align(self, group: list[tuple]) -> Iterator[tuple]:
        if not group:
            return
        a, b = np.concatenate([x[1] for x in group]), np.concatenate([x[2] for x in group])
        found = Alignment(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        after_a, after_b = np.cumsum([len(x[1]) for x in group]), np.cumsum([len(x[2]) for x in group])
        texts = spelled_groups(found, a, b, self.names, self.a.size)
        link_a, link_b = found.links()
        codes = a[link_a].astype(np.int64) * self.b.size + b[link_b]
        at_groups = np.searchsorted(found.common_a, after_a - 1, side="right")
        at_links = np.searchsorted(link_a, after_a - 1, side="right")
        was = (0, 0, 0, 0)
        for now in zip(after_a.tolist(), after_b.tolist(), at_groups.tolist(), at_links.tolist(), strict=True):
            n_a, n_b, n_groups, n_links = (x - y for x, y in zip(now, was, strict=True))
            joined = "".join(texts[was[0] + was[1] : now[0] + now[1]])[:-1]
            pairs, times = np.unique(codes[was[3] : now[3]], return_counts=True)
            yield n_a, n_b, n_groups, n_links, hashlib.sha256(joined.encode()).hexdigest(), pairs, times.astype(np.int32)
            was = now


_WORKER: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker; it outlives a task."""
    if (path_a, path_b) not in _WORKER:
        _WORKER[path_a, path_b] = Aligner(path_a, path_b)
    return _WORKER[path_a, path_b]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _run(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = aligner(path_a, path_b).batch(batch.column("text").to_pylist())
            *counts, sha, pairs, times = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(sha, pa.string()),
                    _lists(pairs, pa.int64()),
                    _lists(times, pa.int32()),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return run


# --- tables --------------------------------------------------------------------------------------------------------


def align(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document: counts, the digest of its groups, its distinct ``pairs`` (A's id times the size of B's
    vocabulary plus B's id) and how many links hold each (``times``).
    """
    path_a, path_b = path_a or public_tokenizers.path(BYTE_LEVEL), path_b or public_tokenizers.path(PIECES)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _run(path_a, path_b), ALIGNED
    )


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, count over the corpus, and whether it is the highest of its B id (``best``)."""
    counts = (
        aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.times").alias("count"))
        .withColumn("_b", F.col("pair") % size_b)
    )
    highest = counts.groupBy("_b").agg(F.max("count").alias("_highest"))
    return counts.join(highest, "_b").select("pair", "count", (F.col("count") == F.col("_highest")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (stored, with a unique ``_row``) with n_best and count_sum instead of its pairs."""
    common = counts.orderBy(F.col("count").desc(), "pair").limit(frequent)
    links = aligned.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    total = F.sum(F.col("times") * F.col("count")).alias("count_sum")
    # Rows of one document lie together here, so these sums leave a task as one row per document.
    near = links.join(F.broadcast(common), "pair").groupBy("_row").agg(best, total)
    far = (
        links.join(F.broadcast(common.select("pair")), "pair", "left_anti")
        .join(counts, "pair")
        .groupBy("_row")
        .agg(best, total)
    )
    sums = near.unionByName(far).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "_row", "left").fillna(0, ["n_best", "count_sum"]).drop("_row")


def alignments(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = documents.sparkSession
    folder = working_folder(spark, "alignment")
    path_b = path_b or public_tokenizers.path(PIECES)
    (
        align(documents, path_a, path_b)
        .withColumn("_row", F.monotonically_increasing_id())
        .write.option("compression", "zstd")
        .parquet(f"{folder}/aligned")
    )
    aligned = spark.read.parquet(f"{folder}/aligned")
    pair_counts(aligned, PieceModel(path_b).size).write.parquet(f"{folder}/counts")
    result = with_counts(aligned, spark.read.parquet(f"{folder}/counts"))
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
