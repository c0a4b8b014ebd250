import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from scenelake.llm import substrings


def brute(rows, window):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if d is None else d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (1 << 62 if d is None else d):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df, window):
    rows = substrings.remove_repeats(df, window).collect()
    for r in rows:
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("window", [1, 5, 13, 30])
def test_against_brute_force(spark, odd, window, monkeypatch):
    monkeypatch.setattr(substrings, "BITS", 1 << 20)
    draw = np.random.default_rng(5)
    word = lambda n: " ".join(draw.choice([f"w{i}" for i in range(400)], n))
    passages = [word(n) for n in (12, 13, 14, 40, 90)]
    rows = []
    for i in range(120):
        parts = [word(int(draw.integers(0, 40)))]
        for p in draw.choice(len(passages), int(draw.integers(0, 3))):
            parts += [passages[p], word(int(draw.integers(0, 9)))]
        rows.append((int(draw.integers(0, 100)), "\n ".join(parts)))
    rows += [(500, "same " * 60), (501, "same " * 20), (502, None)] + [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 1000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df, window) == brute(rows, window)


def test_odd_documents(odd, none):
    assert result(odd, 13) == brute([(r.doc_id, r.text) for r in odd.collect()], 13)
    assert substrings.remove_repeats(none).count() == 0


def test_nothing_repeated(spark):
    rows = [(i, " ".join(f"{i}x{j}" for j in range(30))) for i in range(20)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 13) == brute(rows, 13)


def test_words_and_hashes(monkeypatch):
    texts = ["", "ab", "a b", " a\tb\x0b", None, "c" * 9, "ab a", "é ab", "x" * 70_000 + " ab"]
    words = substrings.Words(pa.array(["skipped", *texts]).slice(1))
    raw = words.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(words.start, words.end, strict=True)]
    want = [w for t in texts for w in (t or "").split()]
    assert got == want and words.first.tolist() == np.cumsum([0] + [len((t or "").split()) for t in texts]).tolist()
    by_word = {}
    for w, h in zip(got, words.hash.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(substrings, "SLICE", 3)
    assert (substrings.Words(pa.array(texts)).hash == words.hash).all()


def test_levels():
    assert substrings.lengths(13) == [7, 13] and substrings.lengths(50) == [7, 13, 25, 50] and substrings.lengths(5) == [5]
    assert substrings.smallest(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def test_long_words_that_differ_by_a_pattern():
    """Sums of letters times powers of one number agree on these two words; they are different words."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 11)]
    pair = ["".join("ab"[b ^ turn] for b in bits) for turn in (0, 1)]
    common = " ".join(f"w{i}" for i in range(12))
    words = substrings.Words(pa.array([f"{common} {p}" for p in pair]))
    first, second = words.hash[:13], words.hash[13:]
    assert np.array_equal(first[:12], second[:12]) and first[12] != second[12]
    assert words.windows(13)[0] != words.windows(13)[13]


def test_hash_is_of_letters_and_places_only():
    import random

    draw = random.Random(5)
    made = ["".join(draw.choices("abé.", k=draw.choice([1, 2, 63, 64, 65, 130, 900]))) for _ in range(400)]
    together = substrings.Words(pa.array([" ".join(made)])).hash
    alone = np.concatenate([substrings.Words(pa.array([w])).hash for w in made])
    assert np.array_equal(together, alone) and len(set(together.tolist())) == len(set(made))
