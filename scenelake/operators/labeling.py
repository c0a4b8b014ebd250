"""Weather labeling of samples: what is unlabeled, and spreading a label over following frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators.sliding import range_aggregate

SPREAD_SECONDS = 60


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def unlabeled(samples: DataFrame, label: str = "custom") -> DataFrame:
    """Samples whose label is missing or empty."""
    return samples.where(F.col(label).isNull() | (F.col(label) == ""))


def next_unlabeled(
    samples: DataFrame, location: str = "location", time: str = "time", uid: str = "weather_uid", label: str = "custom"
) -> DataFrame:
    """Earliest unlabeled sample of each location, uid breaking ties: (location, time, uid)."""
    first = F.min(F.struct(F.col(time), F.col(uid))).alias("_first")
    return unlabeled(samples, label).groupBy(location).agg(first).select(location, "_first.*")


def label_events(samples: DataFrame, labels: DataFrame, uid: str = "weather_uid") -> DataFrame:
    """Place label events (uid, label, seq) in time and space through the sample they were given to."""
    return labels.join(samples.select(uid, "location", "time"), uid)


def winning_labels(samples: DataFrame, events: DataFrame, seconds: int = SPREAD_SECONDS) -> DataFrame:
    """(weather_uid, label): the label event with the highest ``seq`` covering each sample.

    An event at ``t0`` covers its location's samples with ``t0 <= t <= t0 + seconds``.
    ``seq`` is unique, so only numbers travel and the labels join at the end.
    """
    values = events.select("location", micros("time").alias("at"), F.col("seq").cast("long").alias("value"))
    probes = samples.select(
        "location",
        F.col("weather_uid").alias("probe_id"),
        (micros("time") - seconds * 1_000_000).alias("start"),
    )
    won = range_aggregate(values, probes, "location", seconds * 1_000_000, F.max, F.greatest)
    named = events.select(F.col("seq").cast("long").alias("result"), "label")
    return won.join(named, "result").select(F.col("probe_id").alias("weather_uid"), "label")


def apply_labels(samples: DataFrame, labels: DataFrame, seconds: int = SPREAD_SECONDS) -> DataFrame:
    """Samples with ``custom`` set by a batch of label events (weather_uid, label, seq).

    A covered sample takes the winning label, also when that label is NULL.
    """
    won = winning_labels(samples, label_events(samples, labels), seconds)
    won = won.withColumnRenamed("label", "_label").withColumn("_hit", F.lit(True))
    custom = F.when(F.col("_hit"), F.col("_label")).otherwise(F.col("custom"))
    return samples.join(won, "weather_uid", "left").withColumn("custom", custom).select(samples.columns)


def covered_counts(samples: DataFrame, events: DataFrame, seconds: int = SPREAD_SECONDS) -> DataFrame:
    """(seq, labeled_images): samples each label event covers, the labeled one included."""
    values = samples.select("location", micros("time").alias("at"), F.lit(1).cast("long").alias("value"))
    probes = events.select("location", F.col("seq").alias("probe_id"), micros("time").alias("start"))
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    counted = range_aggregate(values, probes, "location", seconds * 1_000_000, F.sum, add)
    return counted.select(F.col("probe_id").alias("seq"), F.col("result").alias("labeled_images"))
