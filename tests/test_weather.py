import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scenelake.functions.sun import sun_times, twilight
from scenelake.operators import weather as W
from scenelake.operators.labeling import micros

SAMPLES = "uid INT, location STRING, time TIMESTAMP"


def reference_times(when: datetime, lat: float, lon: float) -> dict[str, float]:
    """The public formulas in plain Python, in days since J2000."""
    rad = math.pi / 180
    now = when.timestamp() / 86400 - 0.5 + 2440588 - 2451545
    lw, phi = -lon * rad, lat * rad
    n = round(now - 0.0009 - lw / (2 * math.pi))
    ds = 0.0009 + lw / (2 * math.pi) + n
    m = rad * (357.5291 + 0.98560028 * ds)
    ecl = m + rad * (1.9148 * math.sin(m) + 0.02 * math.sin(2 * m) + 0.0003 * math.sin(3 * m)) + rad * 102.9372 + math.pi
    dec = math.asin(math.sin(rad * 23.4397) * math.sin(ecl))
    eq = 0.0053 * math.sin(m) - 0.0069 * math.sin(2 * ecl)

    def evening(h):
        w = math.acos((math.sin(h * rad) - math.sin(phi) * math.sin(dec)) / (math.cos(phi) * math.cos(dec)))
        return 0.0009 + (w + lw) / (2 * math.pi) + n + eq

    sunset, dusk = evening(-0.833), evening(-12)
    return {"now": now, "sunset": sunset, "dusk": dusk, "sunrise": 2 * (ds + eq) - sunset, "dawn": 2 * (ds + eq) - dusk}


def utc(*parts):
    from datetime import timezone

    return datetime(*parts, tzinfo=timezone.utc)


@pytest.mark.parametrize("when", [utc(2018, 8, 1, 21), utc(2018, 12, 24, 3), utc(2020, 2, 29, 12)])
def test_sun_times_agree_with_plain_formulas(spark, when):
    lat, lon = 42.336849169438615, -71.05785369873047
    df = spark.createDataFrame([(when,)], "time TIMESTAMP")
    times = sun_times(micros("time"), F.lit(lat), F.lit(lon))
    got = df.select(*[c.alias(k) for k, c in times.items()]).first().asDict()
    want = reference_times(when, lat, lon)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dusk_dawn_and_bounds(spark):
    lat, lon = 42.336849169438615, -71.05785369873047
    rows = [(1, utc(2018, 8, 1, 9, 0)), (2, utc(2018, 8, 2, 0, 30)), (3, utc(2018, 8, 1, 17)), (4, utc(2018, 8, 1, 5))]
    df = spark.createDataFrame(rows, "uid INT, time TIMESTAMP")
    got = {r.uid: r.t for r in df.select("uid", twilight(micros("time"), F.lit(lat), F.lit(lon)).alias("t")).collect()}
    assert got == {1: "dawn", 2: "dusk", 3: None, 4: None}


def test_polar_summer_has_no_twilight(spark):
    df = spark.createDataFrame([(utc(2020, 6, 21, h),) for h in range(24)], "time TIMESTAMP")
    lit = df.select(twilight(micros("time"), F.lit(78.0), F.lit(15.0)).alias("t"))
    assert {r.t for r in lit.collect()} == {None}


def archive(spark):
    rows = [("boston-seaport", utc(2018, 8, 1, h), c, d) for h, c, d in [(9, 61, 1), (17, 0, 1), (5, 45, 0)]]
    return spark.createDataFrame(rows, "location STRING, hour TIMESTAMP, weather_code INT, is_day INT")


def test_enrichment(spark):
    rows = [(1, utc(2018, 8, 1, 9, 10)), (2, utc(2018, 8, 1, 17, 59)), (3, utc(2018, 8, 1, 5, 0))]
    df = spark.createDataFrame([(u, "boston-seaport", t) for u, t in rows], SAMPLES)
    got = {r.uid: (r.weather, r.tod) for r in W.enrich(df, archive(spark)).collect()}
    assert got == {1: ("Light Rain", "dawn"), 2: ("Clear Sky", "day"), 3: ("Fog", "night")}
    titled = {r.uid: r.tod for r in W.enrich(df, archive(spark), title=True).collect()}
    assert titled == {1: "dawn", 2: "Day", 3: "Night"}


@pytest.mark.parametrize("place", ["atlantis", None])
def test_unknown_places_fail_unless_lenient(spark, place):
    df = spark.createDataFrame([(1, place, utc(2018, 8, 1))], SAMPLES)
    with pytest.raises(Exception, match="unknown location"):
        W.with_gps(df).select("uid").collect()
    assert W.with_gps(df, strict=False).first()["lat"] is None


def test_unknown_weather_codes_fail(spark):
    df = spark.createDataFrame([(1, 4)], "uid INT, weather_code INT")
    with pytest.raises(Exception, match="unknown weather code"):
        W.with_weather_text(df).select("uid").collect()
