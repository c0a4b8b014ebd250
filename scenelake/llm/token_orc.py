"""Token ids in ORC: ordered shards with row indexes, Bloom filters and run-length coded integers.

Documents are range-partitioned and sorted by doc_id; one task encodes one
slice and writes its file, so files, stripes and row groups cover disjoint
doc_id ranges and a reader can prune all three from metadata. ``ids`` is an
integer column, which ORC stores with its own run-length encoding. Positions
are kept relative to the slice; a small ``slices`` table (one row per written
slice) turns them into global ones, so nothing is numbered in one task.

The split pattern of the byte-level vocabulary puts a blank in front of the
visible character after it, whatever stands before the blank. So a text may be
cut before each blank that no white space of any kind follows, and its words are encoded
by the tokenizers library, each distinct one once per worker while it is
remembered; ids are those of the whole text. ``tests/llm`` compares both over
all Unicode blanks. Texts that hold the string of an added token are encoded whole.

Defined cases: a null or empty text holds the end id only; null doc_ids come
first; rows with equal doc_id are ordered by a hash of their text; an empty
table gives an empty data set; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import whole

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
REMEMBERED = 700_000  # words a worker remembers (some 150 MB); then it starts anew
AT_ONCE = 20_000  # words encoded in one call
GATHERED = 12 << 20  # bytes of text whose words are looked up together
STRIPE_BYTES = 32 << 20
# What Unicode or Python counts as white space.
_WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f" (?=[^{_WHITE}])")
# Texts in which not every blank is a cut; the same class as Arrow's expressions spell it.
_WIDE = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", _WHITE).replace(r"\x85\xa0", r"\x{85}\x{a0}")
_SPACED = f" [{_WIDE}]|[{_WIDE}] $"
SHARD_SCHEMA = "slice int, doc_id long, offset long, n_tokens long, ids array<int>"


class Encoder:
    """Ids of whole texts, with the ids of recent words remembered.

    A word runs from a blank to the next cut. Words are separated and their
    repeats found in Arrow, so Python sees each distinct word of a batch once.
    ``added`` says whether strings of added tokens in a text become those tokens.
    """

    def __init__(self, path: str, added: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        # Each word is encoded once here, so the library's own word memory would only cost time.
        self.tokenizer.model._resize_cache(0)
        self.young: dict[str, bytes] = {}  # ids of a word with the blank before it
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a blank
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<i4").tobytes() for x in found]

    def learn(self, words: list[str]) -> None:
        spaced = [w for w in words if " " in w]
        self.young.update(zip(spaced, self.plain([" " + w for w in spaced]), strict=True))
        words = [w for w in words if " " not in w]
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            together = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0]
            ids = np.array(together.ids, dtype="<i4")
            starts = np.flatnonzero(self.opens[ids]) * 4
            if len(starts) == len(some) and starts[0] == 0:
                raw, cuts = ids.tobytes(), [*starts.tolist(), 4 * len(ids)]
                self.young.update(zip(some, (raw[a:b] for a, b in pairwise(cuts)), strict=True))
            else:  # an added token of the vocabulary stands in a word
                self.young.update(zip(some, self.plain([" " + w for w in some]), strict=True))

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Half of the memory is young; a word found in the old half moves up."""
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, words))
        places = [i for i, x in enumerate(found) if x is None]
        missing = [words[i] for i in places]
        moved = {w: x for w, x in zip(missing, map(self.old.get, missing), strict=True) if x is not None}
        self.young.update(moved)
        self.learn([w for w in missing if w and w not in moved])
        # A blank at the end of a text.
        self.young[""] = self.young.get("") or self.plain([" "])[0]
        for i, w in zip(places, missing, strict=True):
            found[i] = self.young[w]
        return found

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All words of all texts, and where each text's words begin and end among them."""
        odd = pc.match_substring_regex(texts, _SPACED)
        whole_ = reduce(pc.or_, [pc.match_substring(texts, t) for t in self.added], pa.array([False] * len(texts)))
        simple = pc.invert(pc.or_(odd, whole_)).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(simple)), " ")
        parts, ends = [lists.flatten()], np.zeros(len(texts), np.int64)
        begins = np.zeros(len(texts), np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        begins[simple], ends[simple] = offsets[:-1], offsets[1:]
        at, others = int(offsets[-1]), np.flatnonzero(~simple)
        whole_ = whole_.to_numpy(zero_copy_only=False)
        for i in others.tolist():
            text = texts[i].as_py()
            words = [text] if whole_[i] else _CUT.split(text)
            parts.append(pa.array(words, pa.string()))
            begins[i], at = at, at + len(words)
            ends[i] = at
        return pa.concat_arrays(parts), begins, ends

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        words, begins, ends = self._words(texts)
        heads = self.plain(words.take(pa.array(begins)).to_pylist())
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # No blank stands before a text's first word, so it has an entry of its own.
        codes[begins] = len(coded.dictionary) + np.arange(len(begins))
        known = self.of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()) + heads
        arena = np.frombuffer(b"".join(known), "<i4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        counts = ends - begins
        codes = codes[ramps(begins, counts)]  # in the order of the texts
        flat = arena[ramps((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
        upto = np.concatenate([[0], np.cumsum(sizes[codes])])
        after = np.cumsum(counts)
        return flat, upto[after] - upto[after - counts]


def ramps(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (counts[0] numbers), begins[1], ..."""
    before = np.cumsum(counts) - counts
    return np.repeat(begins - before, counts) + np.arange(int(counts.sum()))


_WORKER: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = True) -> Encoder:
    """The encoder of this Python worker; it outlives a task."""
    if (path, added) not in _WORKER:
        _WORKER[path, added] = Encoder(path, added)
    return _WORKER[path, added]


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches together, up to ``size`` bytes or one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        for batch in gathered(batches):
            ids, lengths = encoder(path)(batch.column("text"))
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            flat = np.full(len(ids) + len(lengths), end_id, "<i4")
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = ids
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lengths), number, dtype=np.int32)),
                    batch.column("doc_id"),
                    pa.array(at + ends - lengths),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["slice", "doc_id", "offset", "n_tokens", "ids"],
            )
            at += int(lengths.sum())

    return run


def write_tokens(
    documents: DataFrame,
    folder: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    slices: int | None = None,
) -> None:
    """Encode all texts and write ``folder/shards`` and ``folder/slices`` as ORC.

    ``slices`` is the number of files, by default ``spark.sql.shuffle.partitions``.
    """
    spark = documents.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_tie"]
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    (
        ordered.mapInArrow(_encode(path, end_id), SHARD_SCHEMA)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "zstd")
        .orc(f"{folder}/shards")
    )
    (
        read_shards(spark, folder)
        .groupBy("slice")
        .agg(
            F.count("*").alias("n_docs"),
            F.sum("n_tokens").alias("n_tokens"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
        )
        # One row per written file.
        .withColumn("base", F.sum("n_tokens").over(Window.orderBy("slice")) - F.col("n_tokens"))
        .write.orc(f"{folder}/slices")
    )


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).orc(f"{folder}/shards")


def read_tokens(spark: SparkSession, folder: str, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids. A condition on doc_id prunes files, stripes and row groups."""
    shards = read_shards(spark, folder)
    slices = spark.read.orc(f"{folder}/slices").select("slice", "base")
    return (shards.where(where) if where else shards).join(slices, "slice").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("start"),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
