"""Weather and time of day of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.dims import location_dim, wmo_dim
from scenelake.functions.sun import twilight
from scenelake.operators.labeling import micros
from scenelake.operators.lookup import require


def with_gps(samples: DataFrame, places: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Add lat and lon by location; lenient mode leaves unknown places NULL."""
    places = places if places is not None else location_dim(samples.sparkSession)
    if strict:
        return require(samples, places, "location", "location")
    return samples.join(places, "location", "left")


def with_hourly_weather(samples: DataFrame, archive: DataFrame, strict: bool = True) -> DataFrame:
    """Add weather_code and is_day from the archive row (location, hour) holding the sample's time.

    A sample without such a row fails the job; lenient mode leaves it NULL.
    """
    hourly = archive.select("location", F.col("hour").alias("_hour"), "weather_code", "is_day")
    timed, key = samples.withColumn("_hour", F.date_trunc("hour", "time")), ["location", "_hour"]
    joined = require(timed, hourly, key, "archive hour") if strict else timed.join(hourly, key, "left")
    return joined.drop("_hour")


def with_weather_text(samples: DataFrame, codes: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Add the weather text of ``weather_code``."""
    codes = codes if codes is not None else wmo_dim(samples.sparkSession)
    named = codes.select(F.col("code").alias("weather_code"), F.col("text").alias("weather"))
    if strict:
        return require(samples, named, "weather_code", "weather code")
    return samples.join(named, "weather_code", "left")


def time_of_day(is_day: Column, at_us: Column, lat: Column, lon: Column, title: bool = False) -> Column:
    """Day or night from ``is_day``, replaced by dawn or dusk during twilight.

    ``title`` spells Day and Night with a capital, as one of the datasets does.
    """
    day, night = ("Day", "Night") if title else ("day", "night")
    return F.coalesce(twilight(at_us, lat, lon), F.when(is_day == 0, F.lit(night)).otherwise(F.lit(day)))


def enrich(samples: DataFrame, archive: DataFrame, places: DataFrame | None = None, title: bool = False) -> DataFrame:
    """Samples (time, location, ...) with weather and tod columns."""
    located = with_gps(samples, places)
    coded = with_weather_text(with_hourly_weather(located, archive))
    tod = time_of_day(F.col("is_day"), micros("time"), F.col("lat"), F.col("lon"), title)
    return coded.withColumn("tod", tod).drop("lat", "lon", "weather_code", "is_day")
