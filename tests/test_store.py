import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scenelake.sources.store import SceneStore

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
WEATHER = "time TIMESTAMP, location STRING, weather STRING, tod STRING, dataset STRING, split STRING, seq INT"
CAMERA = "time TIMESTAMP, location STRING, camera_id STRING, image BINARY, camera_box ARRAY<STRUCT<x: DOUBLE, label: STRING>>, seq INT"


def weather(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(seconds=s), p, w, "Day", "d", "training", n) for n, (s, p, w) in enumerate(rows)], WEATHER)


def cameras(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(seconds=s), p, c, i, b, n) for n, (s, p, c, i, b) in enumerate(rows)], CAMERA)


def shown(store):
    samples = sorted((r.weather_uid, r.location, r.weather) for r in store.table("weather").collect())
    images = sorted((r.camera_uid, r.weather_uid, r.camera_id, bytes(r.image)) for r in store.table("camera").collect())
    boxes = sorted((r.camera_uid, [b.label for b in r.camera_box]) for r in store.table("camera_box").collect())
    return samples, images, boxes


def first_batch(spark):
    return {
        "weather": weather(spark, [(0, "a", "Fog"), (0, "a", "Rain"), (5, "b", "Fog")]),
        "camera": cameras(spark, [(0, "a", "l", b"one", [(1.0, "car")]), (0, "a", "l", b"two", None), (5, "b", "r", b"three", [])]),
    }


FIRST = (
    [(1, "a", "Fog"), (2, "b", "Fog")],
    [(1, 1, "l", b"two"), (2, 2, "r", b"three")],
    [(1, ["car"]), (2, [])],
)


def test_batches(spark, tmp_path):
    store = SceneStore.create(spark, str(tmp_path))
    assert shown(store) == ([], [], [])
    store.store_batch(0, first_batch(spark))
    assert shown(store) == FIRST
    # Sensors of an older sample, a new day, a changed image; the first sample row stays.
    store.store_batch(1, {
        "weather": weather(spark, [(0, "a", "Snow"), (90_000, "a", "Snow")]),
        "camera": cameras(spark, [(5, "b", "r", b"four", None), (90_000, "a", "l", b"five", [(2.0, "bus")]), (0, "a", "x", b"six", None)]),
    })
    samples, images, boxes = shown(store)
    assert samples == [(1, "a", "Fog"), (2, "b", "Fog"), (3, "a", "Snow")]
    assert [(i[1:]) for i in images] == [(1, "l", b"two"), (2, "r", b"four"), (1, "x", b"six"), (3, "l", b"five")]
    assert boxes == [(1, ["car"]), (2, []), (4, ["bus"])]
    # The state before the batch can still be read.
    assert store.table("weather", before=1).count() == 2
    assert SceneStore.create(spark, str(tmp_path)).table("weather").count() == 3


@pytest.mark.parametrize("step", ["weather", "camera", "camera_box"])
def test_a_failed_batch_shows_nothing(spark, tmp_path, monkeypatch, step):
    store = SceneStore.create(spark, str(tmp_path))
    store.store_batch(0, first_batch(spark))
    second = {"weather": weather(spark, [(7, "c", "Rain")]), "camera": cameras(spark, [(7, "c", "l", b"new", [(0.0, "van")])])}
    whole = SceneStore._written

    def failing(self, df, table, batch_id):
        out = whole(self, df, table, batch_id)
        if table == step:
            raise RuntimeError("lost after writing")
        return out

    monkeypatch.setattr(SceneStore, "_written", failing)
    with pytest.raises(RuntimeError, match="lost"):
        store.store_batch(1, second)
    assert shown(store) == FIRST
    monkeypatch.setattr(SceneStore, "_written", whole)
    for _ in range(2):  # repeated under its number it changes nothing more
        store.store_batch(1, second)
        assert shown(store) == (
            [*FIRST[0], (3, "c", "Rain")], [*FIRST[1], (3, 3, "l", b"new")], [*FIRST[2], (3, ["van"])]
        )


def test_a_batch_is_put_in_order_once_per_table(spark, tmp_path, monkeypatch):
    from scenelake.operators import upserts

    keys, whole = [], upserts._one_per_key
    monkeypatch.setattr(upserts, "_one_per_key", lambda batch, key, *how, **named: keys.append(tuple(key)) or whole(batch, key, *how, **named))
    store = SceneStore.create(spark, str(tmp_path))
    store.store_batch(0, first_batch(spark))
    assert keys == [("time", "location"), ("weather_uid", "camera_id"), ("camera_uid",)]
    assert shown(store) == FIRST


def size_of(root, batch):
    return sum(
        os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(root) for f in files if f"batch={batch}/" in f"{folder}/"
    )


def test_a_new_row_moves_no_payload(spark, tmp_path):
    """One camera more in a block of ten thousand samples."""
    store, n = SceneStore.create(spark, str(tmp_path)), 9_990
    rows = spark.range(n).select(
        (F.lit(T0) + F.make_interval(secs=F.col("id"))).alias("time"), F.lit("p").alias("location"), F.col("id").cast("int").alias("seq")
    )
    named = rows.select("*", *[F.lit(v).alias(c) for c, v in (("weather", "Fog"), ("tod", "Day"), ("dataset", "d"), ("split", "all"))])
    # Images of 2 KB that do not compress.
    image = F.unhex(F.concat(*[F.sha2(F.concat_ws("-", "seq", F.lit(str(i))), 256) for i in range(64)]))
    store.store_batch(0, {"weather": named, "camera": rows.select("*", F.lit("l").alias("camera_id"), image.alias("image"))})
    store.store_batch(1, {"weather": weather(spark, [(3, "p", "Fog")]), "camera": cameras(spark, [(3, "p", "new", b"x" * 2048, None)])})
    first, second = size_of(tmp_path, 0), size_of(tmp_path, 1)
    assert first > 20_000_000 and second < first / 20, (first, second)
    assert store.narrow("camera").count() == n + 1
    plan = store.table("camera", wide=())._jdf.queryExecution().toString()
    assert "image" not in plan.replace("at_image", "")
