"""Small dimensions with fixed contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# WMO weather interpretation codes.
WMO_CODES = {
    0: "Clear Sky",
    1: "Mainly Clear",
    2: "Partly Cloudy",
    3: "Overcast",
    45: "Fog",
    48: "Depositing Rime Fog",
    51: "Light Drizzle",
    53: "Moderate Drizzle",
    55: "Dense Drizzle",
    56: "Light Freezing Drizzle",
    57: "Dense Freezing Drizzle",
    61: "Light Rain",
    63: "Moderate Rain",
    65: "Heavy Rain",
    66: "Light Freezing Rain",
    67: "Heavy Freezing Rain",
    71: "Light Snow",
    73: "Moderate Snow",
    75: "Heavy Snow",
    77: "Snow Grains",
    80: "Slight Rain Showers",
    81: "Moderate Rain Showers",
    82: "Heavy Rain Showers",
    85: "Slight Snow Showers",
    86: "Heavy Snow Showers",
    95: "Slight or Moderate Thunderstorm",
    96: "Thunderstorm with slight hail",
    99: "Thunderstorm with heavy hail",
}

# Latitude and longitude of the recording places.
LOCATIONS = {
    "boston-seaport": (42.336849169438615, -71.05785369873047),
    "singapore-onenorth": (1.2882100868743724, 103.78475189208984),
    "singapore-hollandvillage": (1.2993652317780957, 103.78217697143555),
    "singapore-queenstown": (1.2782562240223188, 103.76741409301758),
    "location_sf": (37.773972, -122.431297),
    "location_phx": (33.448376, -112.074036),
}


def wmo_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WMO_CODES.items()), "code INT, text STRING")


def location_dim(spark: SparkSession) -> DataFrame:
    rows = [(name, lat, lon) for name, (lat, lon) in LOCATIONS.items()]
    return spark.createDataFrame(rows, "location STRING, lat DOUBLE, lon DOUBLE")
