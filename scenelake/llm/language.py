"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of +1 and -1. Each bit has a binary classifier
over hashed character n-grams (orders 1 to 4 inside a word and its edges):
weights are the log-odds of an n-gram under the languages on either side of
the bit. A text's margin per bit is the sum over all of its words. Decoding
picks the codeword with the smallest loss, the logistic losses of the bits
weighted by how well each bit separates its two sides. The score is the
softmax of the losses; where it stays under ``SURE`` the text is flagged
ambiguous.

Fitting sees a bounded sample of labelled rows: ``PER_LANGUAGE`` rows of each
language, those with the smallest keyed hash of their doc_id. Everything else
covers all rows and whole texts.

Up to ``EXHAUSTIVE`` languages the code is the exhaustive one (every split of
the languages is a bit); beyond that, rows of seeded random splits.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so
is every text if no language could be learned; with one learned language
every other text is of that language with score 1; rows with a null doc_id
are predicted but neither learned from nor held out; repeated rows get equal
results; other columns pass through ``accepted`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_LANGUAGE = 400
PARTS = 256
DIMENSIONS = 1 << 16
ORDERS = 4
SMOOTHING = 0.5
SURE = 0.6
EXHAUSTIVE = 6
SEED = 42
REMEMBERED = 200_000  # words whose margins a worker remembers
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- features ------------------------------------------------------------------------------------------------------


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words, and where each word's begin. Edges of a word count as a blank."""
    flat = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    edge = flat == 32
    # The word that a position belongs to; an edge belongs to the word after it.
    owner = np.cumsum(edge) - 1
    out, of = [], []
    h = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, ORDERS + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1_000_003) + flat[n - 1 :]
        # A gram may end with the edge after its word, but not go on.
        inner = np.zeros(m, dtype=bool)
        if n == 1:
            inner = ~edge
        else:
            inside = np.cumsum(edge)
            crossed = inside[n - 2 : n - 2 + m] - inside[:m] if n > 2 else np.zeros(m, dtype=np.int64)
            inner = (crossed == 0) & ~(edge[:m] & edge[n - 1 :][:m] & (n == 2))
        at = np.flatnonzero(inner)
        x = (h[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((x >> np.uint64(64 - 16)).astype(np.int64) % DIMENSIONS)
        of.append(owner[at])
    h, of = np.concatenate(out), np.concatenate(of)
    keep = of < len(words)
    h, of = h[keep], of[keep]
    order = np.argsort(of, kind="stable")
    return h[order], np.searchsorted(of[order], np.arange(len(words)))


# --- model ---------------------------------------------------------------------------------------------------------


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1; no bit has all languages on one side."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 2 ** (n - 1))
        code = np.array([[(b >> i) & 1 for b in bits] for i in range(n - 1)] + [[0] * len(bits)])
        return code * 2.0 - 1
    draw = np.random.default_rng(SEED)
    width = int(np.ceil(10 * np.log2(n)))
    bits: list[np.ndarray] = []
    while len(bits) < width:
        bit = draw.permutation(np.arange(n) % 2)
        if not any((bit == b).all() or (bit == 1 - b).all() for b in bits):
            bits.append(bit)
    return np.array(bits).T * 2.0 - 1


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    trust: np.ndarray  # per bit

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and score of each row of margins."""
        if not self.code.shape[1]:
            return np.zeros(len(margins), dtype=int), np.ones(len(margins))
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        best = loss.argmin(axis=1)
        rest = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return best, 1 / rest.sum(axis=1)


def fitted(counts: dict[str, np.ndarray]) -> Model:
    """Bit classifiers from n-gram counts per language."""
    languages = sorted(counts)
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIMENSIONS, 0), np.float32), np.ones(0))
    p = np.array([counts[x] for x in languages], dtype=np.float64) + SMOOTHING
    p /= p.sum(axis=1, keepdims=True)
    weights, trust = [], []
    for bit in code.T:
        one, zero = p[bit > 0].mean(axis=0), p[bit < 0].mean(axis=0)
        weights.append(np.log(one / zero))
        trust.append(((one - zero) * weights[-1]).sum())
    trust = np.array(trust)
    # The orders repeat each other's evidence, so a word counts once, not once per order.
    w = (np.array(weights).T / ORDERS).astype(np.float32)
    return Model(languages, code, w, trust / trust.mean() if trust.sum() else np.ones(len(trust)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text or "")
            if words:
                h, _ = grams(words)
                sums.setdefault(lang, np.zeros(DIMENSIONS, np.float64))
                sums[lang] += np.bincount(h, minlength=DIMENSIONS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
        names=["lang", "counts"],
    )


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the labelled rows that are not held out."""
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()
    # The sample is chosen on narrow rows; only its own texts are read in full. Parts of a language
    # are cut first, so that its final choice sees at most PARTS * per_language rows.
    narrow = documents.where(usable).select("doc_id", "lang", F.xxhash64(F.lit(SEED), "doc_id").alias("_draw"))
    for group in (["lang", F.pmod("_draw", F.lit(PARTS))], ["lang"]):
        pick = Window.partitionBy(*group).orderBy("_draw", "doc_id")
        narrow = narrow.withColumn("_rn", F.row_number().over(pick)).where(F.col("_rn") <= per_language).drop("_rn")
    chosen = narrow.select("doc_id", "lang").distinct()
    sample = documents.where(usable).select("doc_id", "lang", "text").join(
        F.broadcast(chosen), ["doc_id", "lang"], "left_semi"
    )
    one = Window.partitionBy("lang").orderBy("doc_id")
    bounded = (
        sample.withColumn("_rn", F.row_number().over(one)).where(F.col("_rn") <= per_language).select("lang", "text")
    )
    parts = bounded.mapInArrow(_count, "lang string, counts binary").collect()
    counts: dict[str, np.ndarray] = {}
    for row in parts:
        counts[row["lang"]] = counts.get(row["lang"], 0) + np.frombuffer(row["counts"])
    return fitted(counts)


# --- prediction ----------------------------------------------------------------------------------------------------


class Predictor:
    """Margins of texts, with the margins of recent words remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        bits = self.model.weights.shape[1]
        self.rows = np.zeros((1024, bits + 1), np.float32)

    def learn(self, new: list[str]) -> None:
        h, starts = grams(new)
        sums = np.add.reduceat(self.model.weights[h], starts) if self.model.weights.shape[1] else np.zeros((len(new), 0))
        at = len(self.known)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(new), :-1] = sums
        self.rows[at : at + len(new), -1] = [any(map(str.isalpha, w)) for w in new]
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous."""
        words = [words_of(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in set().union(*words) if w not in self.known]
        if new:
            self.learn(new)
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        lengths = np.array([len(w) for w in words])
        sums = np.zeros((len(texts), self.rows.shape[1]))
        full = np.flatnonzero(lengths)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][full]
            sums[full] = np.add.reduceat(self.rows[ids], starts, dtype=np.float64)
        best, score = self.model.decode(sums[:, :-1])
        known = (sums[:, -1] > 0) & bool(self.model.languages)
        langs = [self.model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        score = np.where(known, score, 0.0)
        return langs, score, score < SURE


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            langs, score, unsure = predictor(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score),
                 pa.array(unsure)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by languages and DIMENSIONS
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"
    ).mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def _accept(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            _, _, unsure = predictor(batch.column("text").to_pylist())
            yield batch.filter(pa.array(~unsure))

    return run


def accepted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with a language: neither ``und`` nor ambiguous. All columns are kept."""
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_accept(shared), documents.schema)
