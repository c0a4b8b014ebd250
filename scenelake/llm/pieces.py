"""SentencePiece BPE with seeded merge-dropout, and its decoder.

Encoding works on the pieces of a public SentencePiece BPE model. Symbols are
characters (byte pieces where the vocabulary lacks one); an agenda hands out
the adjacent pair whose merged piece scores highest, leftmost first. A
candidate merge is skipped for good when a keyed hash of (seed, document,
chunk, its three bounds) falls below the dropout rate, so one text has varied
segmentations, equal for equal keys. With rate 0 the ids are those of the
sentencepiece library.

No piece of such a model holds the word mark after another character, so a
text falls into independent chunks: a run of blanks and the characters after
it. ``Agenda`` runs all chunks of a batch side by side in numpy: per step each
chunk takes its best remaining candidate. Chunks longer than ``LONG`` symbols
use a heap instead, with the same outcome.

Decoding joins the pieces' bytes. It returns every text exactly, also with
leading blanks, control characters or a literal word mark (spelled in bytes).

Defined cases: a null or empty text has no pieces and decodes to an empty text;
null doc_ids share one key; repeated rows are encoded alike; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import whole

VOCABULARY = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 42
LONG = 64  # symbols of a chunk that still go through the agenda of arrays
AT_ONCE = 50_000  # characters in one agenda
MARK = "▁"

_U = np.uint64
_MASK = (1 << 64) - 1
_NONE = np.iinfo(np.int64).max
# Odd multipliers of the keyed hash.
_LEFT, _MIDDLE, _RIGHT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_MIX1, _MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> _U(30))) * _U(_MIX1)
    x = (x ^ (x >> _U(27))) * _U(_MIX2)
    return x ^ (x >> _U(31))


def _mix_one(x: int) -> int:
    x = ((x ^ (x >> 30)) * _MIX1) & _MASK
    x = ((x ^ (x >> 27)) * _MIX2) & _MASK
    return x ^ (x >> 31)


class Pieces:
    """Tables of one model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        known = {names[i]: i for i in plain}
        self.byte_ids = np.zeros(256, np.int32)
        for i in byte:
            self.byte_ids[int(names[i][1:-1], 16)] = i
        # Characters to ids; the blank is spelled with the mark, the mark itself in bytes.
        self.char_ids = np.full(0x110000, -1, np.int32)
        for name, i in known.items():
            if len(name) == 1:
                self.char_ids[ord(name)] = i
        self.char_ids[ord(" ")], self.char_ids[ord(MARK)] = self.char_ids[ord(MARK)], -1
        # Equal scores share a rank, so that the leftmost of them wins.
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int64)
        pairs = {}
        for name, i in known.items():
            for cut in range(1, len(name)):
                a, b = known.get(name[:cut]), known.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.n = n
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.levels = self._levels(keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int32))
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = names[i].replace(MARK, " ").encode()
        for i in byte:
            self.bytes[i] = bytes([int(names[i][1:-1], 16)])

    @staticmethod
    def _levels(keys: np.ndarray, values: np.ndarray) -> list[tuple]:
        """Hash tables of falling size; a key that finds its place taken moves to the next one."""
        out, bits, salt = [], 20, 1
        while len(keys):
            slot = ((keys.astype(_U) * _U(_LEFT + 2 * salt)) >> _U(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            table[slot[first]], value[slot[first]] = keys[first], values[first]
            out.append((bits, _U(_LEFT + 2 * salt), table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, bits, salt = keys[rest], values[rest], max(12, bits - 3), salt + 1
        return out

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that two symbols form, or -1."""
        key = a.astype(np.int64) * self.n + b
        out = np.full(len(key), -1, np.int32)
        for bits, factor, table, value in self.levels:
            slot = ((key.astype(_U) * factor) >> _U(64 - bits)).astype(np.int64)
            hit = table[slot] == key
            out[hit] = value[slot[hit]]
        return out


_LOADED: dict[str, Pieces] = {}


def load(path: str | None = None) -> Pieces:
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


# --- encoding ------------------------------------------------------------------------------------------------------


def _heap_chunk(model: Pieces, symbols: list[int], key: int, bar: int) -> list[int]:
    """One chunk through an agenda kept in a heap."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids, agenda = list(symbols), []

    def offer(i: int, j: int) -> None:
        got = model.pairs.get(ids[i] * model.n + ids[j], -1)
        if got < 0:
            return
        drawn = _mix_one(key ^ ((i * _LEFT + j * _MIDDLE + after[j] * _RIGHT) & _MASK))
        if drawn >> 11 >= bar:
            heapq.heappush(agenda, (int(model.rank[got]), i, j, after[j], got))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, i, j, end, got = heapq.heappop(agenda)
        # Stale where either side has changed since.
        if ids[i] < 0 or after[i] != j or ids[j] < 0 or after[j] != end:
            continue
        ids[i], ids[j] = got, -1
        after[i] = end
        if end < n:
            before[end] = i
            offer(i, end)
        if before[i] >= 0:
            offer(before[i], i)
    return [x for x in ids if x >= 0]


def _agenda(model: Pieces, ids: np.ndarray, starts: np.ndarray, keys: np.ndarray, bar: int) -> np.ndarray:
    """Merge all chunks in place; returns which symbols are left."""
    n = len(ids)
    lengths = np.diff(np.append(starts, n))
    owner = np.repeat(np.arange(len(starts)), lengths)
    base = starts[owner]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    value, target = np.full(n, _NONE), np.full(n, -1, np.int32)
    dead = np.zeros(n, bool)

    def offer(i: np.ndarray, j: np.ndarray) -> None:
        """Set the candidate of each left symbol i with its right neighbour j."""
        got = model.merged(ids[i], ids[j])
        value[i] = _NONE
        some = np.flatnonzero(got >= 0)
        i, j, got = i[some], j[some], got[some]
        if bar:
            at = base[i]
            bounds = (
                (i - at).astype(_U) * _U(_LEFT)
                + (j - at).astype(_U) * _U(_MIDDLE)
                + (after[j] - at).astype(_U) * _U(_RIGHT)
            )
            some = np.flatnonzero(_mix(keys[owner[i]] ^ bounds) >> _U(11) >= _U(bar))
            i, j, got = i[some], j[some], got[some]
        value[i] = (model.rank[got] << 32) | (i - base[i])
        target[i] = got

    inner = np.flatnonzero(owner[:-1] == owner[1:])
    offer(inner, inner + 1)
    active = np.flatnonzero(lengths > 1)
    ends = starts + lengths
    while len(active):
        best = np.minimum.reduceat(value, starts[active])
        # A segment runs up to the next active chunk; chunks between them have no candidates left.
        going = best < _NONE
        active, best = active[going], best[going]
        if not len(active):
            break
        i = starts[active] + (best & 0xFFFFFFFF)
        j = after[i]
        ids[i] = target[i]
        dead[j], value[j] = True, _NONE
        end = after[j]
        after[i] = end
        value[i] = _NONE
        right = np.flatnonzero(end < ends[active])
        before[end[right]] = i[right]
        left = np.flatnonzero(before[i] >= starts[active])
        offer(np.concatenate([i[right], before[i[left]]]), np.concatenate([end[right], i[left]]))
    return ~dead


def _chunks(model: Pieces, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of characters, and for each the number of its chunk. ``first`` marks where texts begin."""
    ids = model.char_ids[points]
    blank = points == 32
    fresh = first | (blank & ~np.concatenate([[False], blank[:-1]]))
    chunk = np.cumsum(fresh) - 1
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, chunk
    spelled = [chr(c).encode() for c in points[odd].tolist()]
    width = np.ones(len(points), np.int64)
    width[odd] = [len(x) for x in spelled]
    at = np.cumsum(width) - width
    out = np.repeat(ids, width)
    raw = np.frombuffer(b"".join(spelled), np.uint8)
    where = np.repeat(at[odd], width[odd]) + np.arange(len(raw)) - np.repeat(np.cumsum(width[odd]) - width[odd], width[odd])
    out[where] = model.byte_ids[raw]
    return out, np.repeat(chunk, width)


def _bar(dropout: float) -> int:
    return int(dropout * (1 << 53))


def encode_batch(
    model: Pieces, texts: list[str], doc_keys: np.ndarray, dropout: float = DROPOUT, seed: int = SEED
) -> list[np.ndarray]:
    """Ids of each text; ``doc_keys`` are 64-bit integers, one per text."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    group, size = [], 0
    for i, text in enumerate(texts):
        if text:
            group.append(i)
            size += len(text)
        if group and (size >= AT_ONCE or i == len(texts) - 1):
            for at, ids in zip(group, _encode(model, [texts[g] for g in group], doc_keys[group], dropout, seed), strict=True):
                out[at] = ids
            group, size = [], 0
    return out


def _encode(model: Pieces, texts: list[str], doc_keys: np.ndarray, dropout: float, seed: int) -> list[np.ndarray]:
    points = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le"), np.uint32)
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.zeros(len(points), bool)
    first[text_starts[:-1]] = True
    # The mark before a text begins its first chunk together with the text's own leading blanks.
    symbols, chunk = _chunks(model, points, first)
    starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    # A text's first chunk number, and each chunk's number within its text.
    of_char = np.cumsum(first | ((points == 32) & ~np.concatenate([[False], points[:-1] == 32]))) - 1
    text_chunk = of_char[text_starts[:-1]]
    text_of = np.searchsorted(text_chunk, np.arange(len(starts)), side="right") - 1
    number = np.arange(len(starts)) - text_chunk[text_of]
    keys = _mix(_mix(doc_keys.astype(_U) ^ _U(seed))[text_of] + number.astype(_U) * _U(_LEFT))
    bar = _bar(dropout)
    lengths = np.diff(np.append(starts, len(symbols)))
    long = np.flatnonzero(lengths > LONG)
    kept = np.ones(len(symbols), bool)
    for c in long.tolist():
        a, b = int(starts[c]), int(starts[c] + lengths[c])
        got = _heap_chunk(model, symbols[a:b].tolist(), int(keys[c]), bar)
        symbols[a : a + len(got)] = got
        kept[a + len(got) : b] = False
    short = np.flatnonzero(lengths <= LONG)
    inside = np.repeat(lengths <= LONG, lengths)
    some = symbols[inside]
    if len(some):
        kept[inside] = _agenda(model, some, np.cumsum(lengths[short]) - lengths[short], keys[short], bar)
        symbols[inside] = some
    ends = starts[text_chunk[1:]] if len(texts) > 1 else np.zeros(0, np.int64)
    return [s[k] for s, k in zip(np.split(symbols, ends), np.split(kept, ends), strict=True)]


def decode(model: Pieces, ids: np.ndarray | list[int]) -> str:
    """The text of a sequence of ids."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    return b"".join(map(model.bytes.__getitem__, ids))[1:].decode()


# --- tables --------------------------------------------------------------------------------------------------------


def _run(path: str, dropout: float, seed: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc_keys = np.array(batch.column("_key").to_pylist(), np.int64).view(np.uint64)
            ids = encode_batch(model, texts, doc_keys, dropout, seed)
            counts = np.array([len(x) for x in ids], np.int64)
            columns = {"doc_id": batch.column("doc_id"), "n_pieces": pa.array(counts)}
            if digests:
                back = [decode(model, x) for x in ids]
                columns |= {
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "text_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    "lossless": pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_()),
                }
            else:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        whole("text").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_key"),
    )


def encode(
    documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, vocabulary: str | None = None
) -> DataFrame:
    """doc_id, n_pieces and ids of every document."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return _keyed(documents).mapInArrow(
        _run(path, dropout, seed, False), "doc_id long, n_pieces long, ids array<int>"
    )


def round_trip(
    documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, vocabulary: str | None = None
) -> DataFrame:
    """Encode and decode every document: n_pieces, CRC-32 of the ids, SHA-256 of the decoded text, and whether it is the text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return _keyed(documents).mapInArrow(
        _run(path, dropout, seed, True),
        "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, lossless boolean",
    )


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [decode(model, x) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return run


def decoded(pieces: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return pieces.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
