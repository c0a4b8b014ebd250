from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scenelake.operators import upserts
from scenelake.streaming import ingest, labels

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
SAMPLE = "time TIMESTAMP, location STRING, v INT"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def drop(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_ingest_replays_and_archives(spark, tmp_path):
    inbox, archive, store = tmp_path / "inbox", tmp_path / "archive", str(tmp_path / "store")
    schema, calls = "uid BIGINT, " + SAMPLE, []

    def merge(batch, batch_id):
        calls.append(batch_id)
        old = ingest.version_of(batch.sparkSession, store, schema, batch_id)
        rows = batch.withColumn("seq", F.col("v"))
        ingest.write_version(upserts.insert_first(old, rows, ["time", "location"], "seq", "uid"), store, batch_id)
        if calls.count(batch_id) == 1 and batch_id == 1:
            raise RuntimeError("lost after writing")

    def run():
        stream = ingest.watch(spark, SAMPLE, str(inbox), "*.parquet", archive=str(archive))
        ingest.into_batches(stream, merge, str(tmp_path / "checkpoint"), once=True).awaitTermination()
        return sorted((r.uid, r.location, r.v) for r in ingest.version_of(spark, store, schema, max(calls) + 1).collect())

    drop(spark, inbox, [(at(0), "a", 1), (at(0), "a", 2), (at(0), "b", 3)], SAMPLE)
    assert run() == [(1, "a", 1), (2, "b", 3)]
    drop(spark, inbox, [(at(0), "a", 9), (at(1), "a", 10)], SAMPLE)
    with pytest.raises(Exception, match="lost after writing"):
        run()
    assert run() == [(1, "a", 1), (2, "b", 3), (3, "a", 10)]
    assert calls == [0, 1, 1]
    # A later batch moves the files of finished ones.
    drop(spark, inbox, [(at(2), "c", 1)], SAMPLE)
    run()
    assert len(list(archive.rglob("part-*.parquet"))) >= 1


def test_first_per_sample(spark, tmp_path):
    drop(spark, tmp_path / "in", [(at(0), "a", 1), (at(0), "b", 2)], SAMPLE)
    stream = lambda: ingest.first_per_sample(ingest.watch(spark, SAMPLE, str(tmp_path / "in"), "*.parquet"))
    run = lambda: ingest.append_available(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    drop(spark, tmp_path / "in", [(at(0), "a", 3), (at(1), "a", 4)], SAMPLE)
    run()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4]


def test_propagation_bounds(spark, tmp_path):
    frames = [(i, "p", at(s)) for i, s in enumerate([-1, 0, 59, 60, 61])] + [(9, "q", at(0))]
    drop(spark, tmp_path / "f", frames, "weather_uid INT, location STRING, time TIMESTAMP")
    drop(spark, tmp_path / "l", [(1, "wet", "p", at(0)), (2, "dry", "p", at(59))], "seq INT, label STRING, location STRING, time TIMESTAMP")
    f = ingest.watch(spark, "weather_uid INT, location STRING, time TIMESTAMP", str(tmp_path / "f"), "*.parquet")
    e = ingest.watch(spark, "seq INT, label STRING, location STRING, time TIMESTAMP", str(tmp_path / "l"), "*.parquet")
    ingest.append_available(labels.propagate(f, e), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.weather_uid, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 2)]


@pytest.fixture
def rocks(spark):
    name, value = labels.STATE_STORE
    spark.conf.set(name, value)
    yield
    spark.conf.unset(name)


BIG = (1 << 60) + 1
MIXED = "location STRING, time TIMESTAMP, weather_uid BIGINT, seq BIGINT, label STRING"


def test_winners_by_state(spark, tmp_path, rocks):
    """One row per frame; a label that comes late but within the delay still wins, one beyond it does not count."""
    stream = lambda: labels.propagate_winners(ingest.watch(spark, MIXED, str(tmp_path / "in"), "*.parquet"), "100 seconds")

    def run(rows):
        drop(spark, tmp_path / "in", rows, MIXED)
        ingest.append_available(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
        return sorted((r.weather_uid - BIG, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    frame = lambda uid, s, place="p": (place, at(s), uid + BIG, None, None)
    label = lambda seq, s, text, place="p": (place, at(s), None, seq, text)
    assert run([frame(1, 0), frame(2, 60), frame(3, 61), frame(4, 30, "q"), label(1, 0, "wet"), label(9, 70, "dry")]) == []
    # Late by 80 seconds against 100: it covers frames 2 and 3 and outranks the first.
    assert run([label(5, 10, "late"), frame(5, 90)]) == []
    assert run([frame(6, 400, "q")]) == [(1, "wet"), (2, "late"), (3, "late"), (5, "dry")]
    # The slot is settled; nothing changes any more.
    assert run([label(99, 0, "too late"), frame(7, 900, "q")]) == [(1, "wet"), (2, "late"), (3, "late"), (5, "dry")]


def test_winners_match_brute_force():
    import random

    import pandas as pd

    draw = random.Random(2)
    for _ in range(60):
        frames = [(i, draw.randrange(40)) for i in range(draw.randrange(25))]
        given = [(draw.randrange(40), s, f"l{s}") for s in draw.sample(range(-50, 50), draw.randrange(12))]
        want = []
        for uid, t in frames:
            over = [(s, v) for a, s, v in given if a <= t <= a + 7]
            if over:
                want.append((uid, max(over)[1]))
        got = labels.winners_in(pd.DataFrame(frames, columns=["weather_uid", "at"]), pd.DataFrame(given, columns=["at", "seq", "label"]), 7)
        assert sorted(zip(got["weather_uid"], got["label"], strict=True)) == sorted(want)
