"""Fill-in-the-middle: cut a text in three, exchange blocks in place, and take the exchange back.

A text is cut at line ends into prefix, middle and suffix. Both cuts, whether
the text is changed at all and which of two orders it gets follow from a
SHA-256 of seed and doc_id, so any engine can repeat them. The text's bytes
stand in one bytearray; a sentinel is put in front of each segment, and the
blocks change places by rotation: each of two neighbouring blocks is reversed,
then both together. ``psm`` exchanges middle and suffix, ``spm`` moves the
suffix to the front. Sentinels stay with their segment, so the restorer finds
the blocks by their sentinels, rotates back and deletes the sentinels.

A text that holds a sentinel's characters stays plain, so a sentinel in an
output is always one that was inserted. No sentinel can arise across a seam:
each begins with ``<`` and ends with ``>`` and has neither inside.

Defined cases: a null or empty text stays plain, with output ''; a null doc_id
draws like the empty string; repeated rows are treated alike; texts of any
length are handled whole; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import whole

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
RATE = 100  # per cent of texts that are changed
SPM_RATE = 50  # per cent of the changed ones that get the order suffix, prefix, middle
_NEWLINE = 10

TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def line_ends(raw: bytes) -> np.ndarray:
    """Byte offsets at which lines end; the last line ends with the text."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == _NEWLINE) + 1
    return ends if not raw or raw[-1] == _NEWLINE else np.append(ends, len(raw))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))


def rotate(block: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``block[start:cut]`` and ``block[cut:end]`` by three reversals."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        block[a:b] = block[a:b][::-1]


def _characters(raw: bytes | bytearray) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def transform_one(
    raw: bytes, numbers: tuple[int, ...], rate: int = RATE, spm_rate: int = SPM_RATE
) -> tuple[int, str, int | None, int | None, bytes | bytearray]:
    """(lines, form, characters of the prefix, of the middle, output) of one text in UTF-8."""
    ends = line_ends(raw)
    h1, h2, h3, h4 = numbers
    if not raw or h3 % 100 >= rate or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, raw
    first, second = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a = int(ends[first - 1]) if first else 0
    b = int(ends[second - 1]) if second else 0
    block = bytearray(raw)
    block[b:b] = SUFFIX
    block[a:a] = MIDDLE
    block[0:0] = PREFIX
    middle, suffix = len(PREFIX) + a, len(PREFIX) + b + len(MIDDLE)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    rotate(block, 0 if form == "spm" else middle, suffix, len(block))
    return len(ends), form, _characters(raw[:a]), _characters(raw[a:b]), block


def restore_one(output: bytes, form: str) -> bytes | bytearray:
    """The exact text of an output and its form."""
    if form == "plain":
        return output
    block = bytearray(output)
    if form == "spm":
        # suffix | prefix middle  ->  prefix middle | suffix
        rotate(block, 0, block.index(PREFIX), len(block))
    else:
        # prefix, suffix | middle  ->  prefix, middle | suffix
        rotate(block, block.index(SUFFIX), block.index(MIDDLE), len(block))
    middle = block.index(MIDDLE)
    suffix = block.index(SUFFIX, middle)
    for at, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del block[at : at + len(sentinel)]
    return block


def _transform(seed: int, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [
                transform_one(text.as_buffer().to_pybytes(), draws(doc_id, seed), rate, spm_rate)
                for text, doc_id in zip(batch.column("text"), ids.to_pylist(), strict=True)
            ]
            n, form, before, middle, output = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(before, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array([bytes(x) for x in output], pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def transform(documents: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output of every document."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return narrow.mapInArrow(_transform(seed, rate, spm_rate), TRANSFORMED)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        restored = [
            bytes(restore_one(output.as_buffer().to_pybytes(), form))
            for output, form in zip(batch.column("output"), batch.column("form").to_pylist(), strict=True)
        ]
        yield batch.append_column("restored", pa.array(restored, pa.binary()).cast(pa.string()))


def restore(transformed: DataFrame) -> DataFrame:
    """``transform``'s rows with the text rebuilt from output and form as ``restored``."""
    return transformed.select(*TRANSFORMED.replace(",", " ").split()[::2]).mapInArrow(
        _restore, f"{TRANSFORMED}, restored string"
    )


def digests(restored: DataFrame) -> DataFrame:
    """The rows with SHA-256 digests in place of both texts."""
    return restored.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), u AS (
  SELECT doc_id, text,
         regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
         ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
         ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4
  FROM t
), c AS (
  SELECT doc_id, text, len(units)::BIGINT AS n, units,
         (least(h1 % (len(units) + 1)::UBIGINT, h2 % (len(units) + 1)::UBIGINT))::BIGINT AS a,
         (greatest(h1 % (len(units) + 1)::UBIGINT, h2 % (len(units) + 1)::UBIGINT))::BIGINT AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), s AS (
  SELECT doc_id, text, n, form,
         coalesce(array_to_string(units[1:a], ''), '') AS p,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS z
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
