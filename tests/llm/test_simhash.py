import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from scenelake.llm import simhash
from scenelake.llm.components import components

U = np.uint64


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    texts = ["", "a", "A b", "a b c d", "É x\ty\x0bZ w q", "a b c d a b c d " * 9, "x" * 500] + [r.text or "" for r in odd.collect()][:6]
    assert simhash.fingerprint_batch(texts).tolist() == [brute_fingerprint(t) for t in texts]


def test_anchors_cover_every_link():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 1 << 63, 3000, dtype=np.int64).view(U) << U(1)
    y = x.copy()
    for i in range(len(y)):
        for bit in draw.choice(64, draw.integers(0, 5), replace=False):
            y[i] ^= U(1) << U(bit)
    rows, keys = simhash.replicas(y.view(np.int64))
    spread = set(zip(rows.tolist(), keys.tolist(), strict=True))
    own = simhash.own_anchors(x.view(np.int64))
    assert all(any((i, int(k[i])) in spread for k in own) for i in range(len(x)))
    assert len(rows) / len(x) < 200


def test_golay_code_is_perfect():
    cover = simhash.covering()
    assert (cover.over[cover.first] == 0).all() and (np.bincount(np.repeat(np.arange(2048), cover.count)[cover.over == 0]) == 1).all()


def brute_components(rows):
    fps = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    names = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            names[find(fp)] = min(names.get(find(fp), doc_id), doc_id)
    return {fp: names.get(find(fp)) for fp in fps}


def test_components_of_near_copies(spark, odd):
    draw = np.random.default_rng(4)
    base = [" ".join(draw.choice(list("abcdefghij"), 300)) for _ in range(8)]
    rows = []
    for i in range(160):
        words = base[i % 8].split()
        for at in draw.choice(300, i // 40, replace=False):
            words[at] = "z"
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    told = [(d, brute_fingerprint(t)) for d, t in rows]
    want = brute_components(told)
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.fingerprint, r.doc_id or -1) for r in got) == sorted((f"{fp:016x}", d or -1) for d, fp in told)
    assert all(r.component_id == want[int(r.fingerprint, 16)] for r in got)


def test_one_document_of_each(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    named = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(named - {None})
    assert simhash.one_of_each(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        simhash.links(none.selectExpr("doc_id as fp"), threshold=5)


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(5, i) for i in range(40)], [(i % 7, i) for i in range(50)] + [(100, 101)],
])
def test_star_rounds(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def test_one_row_of_every_component(spark):
    draw = np.random.default_rng(6)
    base = [" ".join(draw.choice(list("abcdefghij"), 300)) for _ in range(5)]
    near = lambda text: text[:-1] + "z"
    rows = [
        (1, base[0], "x"), (1, base[1], "x"), (2, near(base[1]), "x"), (1, base[0], "x"),
        (3, base[2], "x"), (None, base[2], "x"), (None, near(base[2]), "x"),
        (None, base[3], "x"), (None, near(base[3]), "x"), (None, base[4], "x"),
    ]
    told = [brute_fingerprint(t) for t in base]
    assert all((a ^ b).bit_count() > 4 for a, b in combinations(told, 2))
    assert all((brute_fingerprint(near(t)) ^ fp).bit_count() <= 4 for t, fp in zip(base, told))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    got = [(r.doc_id, next(i for i, t in enumerate(base) if r.text in (t, near(t)))) for r in kept.collect()]
    assert sorted(got, key=lambda r: r[1]) == [(1, 0), (1, 1), (3, 2), (None, 3), (None, 4)]
    assert (1, base[1]) in {(r.doc_id, r.text) for r in kept.collect()}
