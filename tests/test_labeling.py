import random
from datetime import datetime, timedelta

from scenelake.operators import labeling as L

T0 = datetime(2020, 1, 1, 0, 0, 59)
SAMPLES = "weather_uid BIGINT, location STRING, time TIMESTAMP, custom STRING"


def samples(spark, offsets, place="p"):
    rows = [(i, place, T0 + timedelta(microseconds=us), None) for i, us in enumerate(offsets)]
    return spark.createDataFrame(rows, SAMPLES)


def labels(spark, rows):
    return spark.createDataFrame(rows, "weather_uid BIGINT, label STRING, seq BIGINT")


def custom(df):
    return {r.weather_uid: r.custom for r in df.collect()}


def test_the_range_is_closed(spark):
    s = samples(spark, [0, 60_000_000, 60_000_001, -1_000_000, 30_000_000])
    out = L.apply_labels(s, labels(spark, [(0, "wet", 1)]))
    assert custom(out) == {0: "wet", 1: "wet", 2: None, 3: None, 4: "wet"}
    events = L.label_events(s, labels(spark, [(0, "wet", 1)]))
    assert [tuple(r) for r in L.covered_counts(s, events).collect()] == [(1, 3)]


def test_other_places_are_left_alone(spark):
    s = samples(spark, [0, 1]).union(samples(spark, [0, 1], "q").selectExpr("weather_uid + 10", "location", "time", "custom"))
    assert custom(L.apply_labels(s, labels(spark, [(0, "wet", 1)]))) == {0: "wet", 1: "wet", 10: None, 11: None}


def test_the_later_event_wins_not_the_later_time(spark):
    s = samples(spark, [0, 10_000_000, 20_000_000, 65_000_000])
    out = custom(L.apply_labels(s, labels(spark, [(0, "late", 2), (1, "early", 1)])))
    assert out == {0: "late", 1: "late", 2: "late", 3: "early"}


def test_a_null_label_overwrites(spark):
    s = spark.createDataFrame([(1, "p", T0, "old"), (2, "p", T0 + timedelta(hours=1), "old")], SAMPLES)
    assert custom(L.apply_labels(s, labels(spark, [(1, None, 1)]))) == {1: None, 2: "old"}


def test_against_brute_force_with_a_hot_place_and_equal_times(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["hot"] * 4 + ["p", "q"]), T0 + timedelta(seconds=rng.randrange(0, 900, 7)), None) for i in range(400)
    ]
    given = [(uid, f"l{k}", k if k % 2 else -k) for k, uid in enumerate(rng.sample(range(400), 60), 1)]
    s = spark.createDataFrame(rows, SAMPLES)
    at = {r[0]: (r[1], r[2]) for r in rows}
    want, counts = {}, {}
    for uid, place, t, _ in rows:
        hits = [(seq, lab) for u, lab, seq in given if at[u][0] == place and timedelta(0) <= t - at[u][1] <= timedelta(seconds=60)]
        want[uid] = max(hits)[1] if hits else None
        for seq, _ in hits:
            counts[seq] = counts.get(seq, 0) + 1
    batch = labels(spark, given)
    assert custom(L.apply_labels(s, batch)) == want
    assert {r.seq: r.labeled_images for r in L.covered_counts(s, L.label_events(s, batch)).collect()} == counts


def test_next_unlabeled(spark):
    rows = [
        (1, "p", T0, "done"),
        (3, "p", T0 + timedelta(seconds=1), ""),
        (2, "p", T0 + timedelta(seconds=1), None),
        (4, "q", T0, "done"),
    ]
    s = spark.createDataFrame(rows, SAMPLES)
    assert sorted(r.weather_uid for r in L.unlabeled(s).collect()) == [2, 3]
    assert [(r.location, r.weather_uid) for r in L.next_unlabeled(s).collect()] == [("p", 2)]
