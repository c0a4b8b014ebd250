import re

from scenelake.llm import license_scan

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
MIT = next(t for label, t in license_scan.NOTICES if label == "mit")


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [
        (i, label)
        for label, phrase in PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


def test_base_places(spark, odd):
    texts = [r.text for r in odd.collect()] + [
        "CC-BY-NC cc by cc by nc cc by nc",
        "under the mit license " * 50,
        "x Apache License, Version 2.0 y under the MIT licence",
        "a b", "cc", "under the mIt license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: row(r) for r in license_scan.scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_notice_with_lost_and_added_words(spark):
    words = MIT.split()
    changed = words[:20] + ["really"] + words[20:30] + words[32:]
    texts = ["Intro. " + MIT.upper() + " end", "x " + " ".join(changed) + " y", " ".join(words[:20]), " ".join(words[::-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].labels for i in range(4)] == ["mit", "mit", "", ""]
    assert all(got[i].base_labels == "" for i in range(4))
    assert got[0].score == 1.0 and 0.8 <= got[1].score < 1 and got[2].score == 0


def test_rows_stay(odd, none):
    assert license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(none).count() == 0
    plan = license_scan.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_notice_beside_a_repeat(spark):
    gpl = next(t for label, t in license_scan.NOTICES if label == "gpl-3")
    short, words = gpl.removeprefix("licensed "), MIT.split()
    changed = " ".join(words[:20] + ["really"] + words[20:30] + words[32:])
    texts = [
        gpl + " see the gnu general public license for details",
        f"{short} {short}",
        " ".join([short] * 40),
        f"see the gnu general public license for details {gpl}",
        # A changed notice, then a part of it again a few diagonals on.
        " ".join([changed, *words[10:30]]),
        " ".join([changed, *["x"] * 4, *words[44:]]),
        "the gnu general public license " * 4,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].labels for i in range(7)] == ["gpl-3"] * 4 + ["mit"] * 2 + [""]
    assert [got[i].score for i in range(4)] == [1.0, 8 / 9, 8 / 9, 1.0] and got[6].score == 0


def every_run(text, words):
    """Best coverage of all runs of neighbouring diagonals of bounded span."""
    seen, found = text.split(), {}
    for pos in range(len(seen) - 2):
        for at in range(len(words) - 2):
            if seen[pos : pos + 3] == words[at : at + 3]:
                found.setdefault(pos - at, set()).add(at)
    diagonals, best = sorted(found), 0.0
    for i in range(len(diagonals)):
        for j in range(i, len(diagonals)):
            run = diagonals[i : j + 1]
            places = [d + at for d in run for at in found[d]]
            covered = len({at + k for d in run for at in found[d] for k in range(3)}) / len(words)
            if (
                all(b - a <= license_scan.SLACK for a, b in zip(run, run[1:]))
                and max(places) + 3 - min(places) <= license_scan.STRETCH * len(words)
                and covered >= license_scan.COVERAGE
            ):
                best = max(best, covered)
    return best


def test_all_runs_are_tried(spark):
    import random

    draw, texts = random.Random(5), []
    for _ in range(150):
        words, parts = draw.choice([t for _, t in license_scan.NOTICES]).split(), []
        for _ in range(draw.randint(1, 4)):
            a, b = sorted(draw.sample(range(len(words) + 1), 2))
            if draw.random() < 0.5:
                a, b = draw.randint(0, 2), len(words) - draw.randint(0, 2)
            parts += words[a:b] + ["x"] * draw.choice([0, 0, 1, 3, 9])
        for _ in range(draw.randint(0, 3)):
            parts.insert(draw.randint(0, len(parts)), "y")
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    notices = [(label, t.split()) for label, t in license_scan.NOTICES]
    runs = {i: [(label, every_run(t, words)) for label, words in notices] for i, t in enumerate(texts)}
    by_notice = {i: set() for i in runs}
    for r in license_scan.spans(df).where("not base").collect():
        by_notice[r.doc_id].add((r.label, r.coverage))
    for i, want in runs.items():
        assert {label for label, best in want if best} == {label for label, _ in by_notice[i]}
        assert max((c for _, c in by_notice[i]), default=0) == max(best for _, best in want)
