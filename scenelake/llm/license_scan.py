"""License scan by diagonal voting, in DataFrame functions only.

Every rolling 3-gram of a document's words is hashed and joined to the gram
positions of the templates (a fixed list, so that side is broadcast). A match
votes for the diagonal "document position - template position". A phrase
stands at a diagonal when all of its grams vote for it; the join compares the
words themselves, so such a place is exact. A whole notice stands on a single
diagonal or on a run of diagonals of one template that lie within ``SLACK``
words of each other (inserted or lost words move the rest of a notice to a
neighbouring diagonal): a run counts when ``COVERAGE`` of the template's words
are covered and its span is not much longer than the template. Every run is
tried, so a repeat close by takes no notice away.

Defined cases: null and empty texts have no words and no labels; documents of
fewer than three words cannot hold a template; repeated rows are scanned
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenelake.llm.common import whole

K = 3
SLACK = 8
COVERAGE = 0.8
STRETCH = 1.5

# Phrases that are labels by themselves wherever they stand.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Opening words of public license notices (at most 60 words each).
NOTICES = [
    ("gpl-3", "licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]

# A-Z need not be lowered before the split: both cases are word characters.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The one letter outside A-Z whose lower case is ASCII; any other non-ASCII letter does in its place.
_KELVIN, _KAPPA = "K", "κ"


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, whether a base phrase, words)."""
    rows = [(label, True, text) for label, text in PHRASES] + [(label, False, text) for label, text in NOTICES]
    return [(i, label, base, text.split()) for i, (label, base, text) in enumerate(rows)]


def _grams() -> list[tuple]:
    return [
        (i, label, base, len(words), at, *words[at : at + K])
        for i, label, base, words in templates()
        for at in range(len(words) - K + 1)
    ]


def words(text: Column | str) -> Column:
    """Words of a text with A-Z lowered."""
    lowered = F.lower(F.replace(whole(text), F.lit(_KELVIN), F.lit(_KAPPA)))
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def votes(documents: DataFrame) -> DataFrame:
    """Matches by diagonal: one row per (document, template, diagonal), and one without template per document.

    ``_mask`` has a bit for every template gram that voted.
    """
    spark = documents.sparkSession
    grams = spark.createDataFrame(
        _grams(), "tid int, label string, base boolean, tlen int, tpos int, t0 string, t1 string, t2 string"
    ).withColumn("_h", F.xxhash64("t0", "t1", "t2"))
    stamped = (
        documents.select("doc_id", words("text").alias("_w"))
        .withColumn("_rid", F.monotonically_increasing_id())
        .withColumn("_n", F.size("_w").cast("long"))
    )
    shifted = [F.when(F.col("_n") > i, F.slice("_w", F.lit(1 + i), F.col("_n").cast("int"))) for i in (1, 2)]
    none = F.array().cast("array<string>")
    rolling = stamped.select(
        "_rid",
        "doc_id",
        "_n",
        F.posexplode_outer(F.arrays_zip(F.col("_w").alias("w0"), *[
            F.coalesce(s, none).alias(f"w{i}") for i, s in enumerate(shifted, 1)
        ])).alias("_pos", "_g"),
    ).select("_rid", "doc_id", "_n", "_pos", "_g.w0", "_g.w1", "_g.w2")
    same = (
        (F.xxhash64("w0", "w1", "w2") == F.col("_h"))
        & (F.col("w0") == F.col("t0"))
        & (F.col("w1") == F.col("t1"))
        & (F.col("w2") == F.col("t2"))
    )
    return (
        rolling.join(F.broadcast(grams), same, "left")
        # The first word of a document stays, so that every document has a row.
        .where(F.col("tid").isNotNull() | (F.coalesce("_pos", F.lit(0)) == 0))
        .groupBy("_rid", "doc_id", "_n", "tid", "label", "base", "tlen", (F.col("_pos") - F.col("tpos")).alias("_diag"))
        .agg(
            F.count("tid").alias("_votes"),
            F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("_mask"),
            F.min("_pos").alias("_lo"),
            F.max(F.col("_pos") + K).alias("_hi"),
        )
    )


def _best_run(earlier: Column) -> Column:
    """(coverage, start, end) of the best run of neighbouring diagonals that ends at the first of ``earlier``.

    ``earlier`` lists diagonals downwards. Every run from there is tried, the single diagonal first, until a step is
    longer than ``SLACK`` or the span too long; of equal coverage the shortest run counts, and none gives nulls.
    """
    none = F.struct(
        F.lit(0).cast("long").alias("mask"),
        earlier[0]["_lo"].alias("lo"),
        earlier[0]["_hi"].alias("hi"),
        earlier[0]["_diag"].alias("diag"),
        F.lit(True).alias("open"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("coverage", "double"), ("start", "int"), ("end", "int"))],
    )

    def longer(run: Column, at: Column) -> Column:
        mask, lo, hi = run["mask"].bitwiseOR(at["_mask"]), F.least(run["lo"], at["_lo"]), F.greatest(run["hi"], at["_hi"])
        fits = run["open"] & (run["diag"] - at["_diag"] <= SLACK) & (hi - lo <= F.col("tlen") * STRETCH)
        covered = _covered(mask)
        better = fits & (covered >= COVERAGE) & (covered > F.coalesce(run["coverage"], F.lit(0.0)))
        return F.struct(
            mask.alias("mask"),
            lo.alias("lo"),
            hi.alias("hi"),
            at["_diag"].alias("diag"),
            fits.alias("open"),
            F.when(better, covered).otherwise(run["coverage"]).alias("coverage"),
            F.when(better, lo).otherwise(run["start"]).alias("start"),
            F.when(better, hi).otherwise(run["end"]).alias("end"),
        )

    return F.aggregate(earlier, none, longer)


def _covered(mask: Column) -> Column:
    """Share of a template's words that the grams of ``mask`` cover."""
    words = mask.bitwiseOR(F.shiftleft(mask, 1)).bitwiseOR(F.shiftleft(mask, 2))
    return F.bit_count(words) / F.col("tlen")


def spans(documents: DataFrame) -> DataFrame:
    """Verified spans: _rid, doc_id, n_words, label, base, start, end, coverage.

    One row per diagonal, with the best span that ends at it; spans of neighbouring diagonals may overlap. A row
    without a span has a null label, and every document has a row.
    """
    # No run within the bounds of its span reaches further back.
    reach = max(int((STRETCH + 1) * len(words)) for _, _, base, words in templates() if not base)
    back = Window.partitionBy("_rid", "tid").orderBy("_diag").rangeBetween(-reach, 0)
    # A phrase is exact on its own diagonal; only notices merge with their neighbours.
    notice = F.when(~F.col("base"), F.struct("_diag", "_mask", "_lo", "_hi"))
    checked = (
        votes(documents)
        .withColumn("_earlier", F.sort_array(F.collect_list(notice).over(back), asc=False))
        .withColumn("_run", F.when(~F.col("base"), _best_run(F.col("_earlier"))))
    )
    exact = F.col("base") & (_covered(F.col("_mask")) == 1)
    found = F.coalesce(exact | F.col("_run.coverage").isNotNull(), F.lit(False))
    of = lambda own, run: F.when(found, F.when(F.col("base"), own).otherwise(F.col(f"_run.{run}"))).alias(run)
    return checked.select(
        "_rid",
        "doc_id",
        F.col("_n").alias("n_words"),
        *[F.when(found, F.col(c)).alias(c) for c in ("label", "base")],
        of(F.col("_lo"), "start"),
        of(F.col("_hi"), "end"),
        of(_covered(F.col("_mask")), "coverage"),
    )


def scan(documents: DataFrame) -> DataFrame:
    """One row per document with its base places and labels."""
    place = F.when(F.col("base"), F.col("start").cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans(documents)
        .groupBy("_rid", "doc_id", "n_words")
        .agg(
            F.count(place).alias("n_base"),
            F.min(place).alias("first_word"),
            F.max(place).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        )
        .drop("_rid")
    )


def sql() -> str:
    """The same votes, merges and checks in DuckDB."""
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    grams = ", ".join("(" + ", ".join(map(quoted, g)) + ")" for g in _grams())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH g(tid, label, base, tlen, tpos, w0, w1, w2) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS w0, unnest(w[2:]) AS w1, unnest(w[3:]) AS w2 FROM d),
v AS (SELECT rid, tid, label, base, tlen, pos - tpos AS diag, bit_or(1::BIGINT << tpos) AS mask,
             min(pos) AS lo, max(pos) + {K} AS hi
      FROM p JOIN g USING (w0, w1, w2) GROUP BY ALL),
s AS (SELECT *, CASE WHEN base OR diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag) > {SLACK}
                THEN 1 ELSE 0 END AS fresh FROM v),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tid ORDER BY diag) AS cluster FROM s),
m AS (SELECT rid, label, base, tlen, bit_or(mask) AS mask, min(lo) AS lo, max(hi) AS hi
      FROM c GROUP BY rid, tid, label, base, tlen, cluster),
f AS (SELECT *, bit_count(mask | (mask << 1) | (mask << 2)) / tlen AS covered FROM m),
k AS (SELECT * FROM f WHERE CASE WHEN base THEN covered = 1
                            ELSE covered >= {COVERAGE} AND hi - lo <= tlen * {STRETCH} END)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (WHERE base) AS n_base,
       (min(lo) FILTER (WHERE base))::BIGINT AS first_word, (max(lo) FILTER (WHERE base))::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(covered), 0.0)::DOUBLE AS score
FROM d LEFT JOIN k USING (rid) GROUP BY d.rid, d.doc_id, len(d.w)
"""
