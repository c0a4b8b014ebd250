"""Label propagation between a stream of frames and a stream of label events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scenelake.operators.labeling import SPREAD_SECONDS, micros

# Lists of state and timers need this state store.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def propagate(frames: DataFrame, labels: DataFrame, delay: str = "10 minutes", seconds: int = SPREAD_SECONDS) -> DataFrame:
    """(weather_uid, time, seq, label) for each label event and each frame it covers.

    Rows meet by place and time slot, so a busy place is spread over its slots.
    Both watermarks bound the join state: rows later than ``delay`` are
    dropped, so labels given long after the drive belong to the batch job.
    ``frames`` has (weather_uid, location, time), ``labels`` (seq, label,
    location, time).
    """
    width = F.lit(seconds)
    slot = F.floor(F.unix_seconds("time") / width)
    f = frames.withWatermark("time", delay).withColumn("_slot", slot).alias("f")
    # A label reaches into its own time slot and the next; a frame lies in exactly one.
    e = (
        labels.withWatermark("time", delay)
        .withColumn("_slot", F.explode(F.array(slot, slot + 1)))
        .alias("e")
    )
    covered = (
        (F.col("f.location") == F.col("e.location"))
        & (F.col("f._slot") == F.col("e._slot"))
        & (F.col("f.time") >= F.col("e.time"))
        & (F.col("f.time") <= F.col("e.time") + F.expr(f"INTERVAL {seconds} SECONDS"))
    )
    return f.join(e, covered).select("f.weather_uid", F.col("f.time").alias("time"), "e.seq", "e.label")


def winners_in(frames: pd.DataFrame, labels: pd.DataFrame, reach: int) -> pd.DataFrame:
    """(weather_uid, at, label) of the frames that a label covers: that of the highest ``seq``.

    ``frames`` has (weather_uid, at), ``labels`` (at, seq, label), times in
    microseconds. Labels are taken from the highest down, and each settles the frames of its
    reach that are still open, so a frame is settled once.
    """
    frames = frames.sort_values("at", kind="stable", ignore_index=True)
    labels = labels.drop_duplicates("seq").sort_values("seq", ascending=False, ignore_index=True)
    at = frames["at"].to_numpy(np.int64)
    given = labels["at"].to_numpy(np.int64)
    first, last = np.searchsorted(at, given), np.searchsorted(at, given + reach, side="right")
    winner = np.full(len(at), -1)
    # The next open frame at or after each one; paths are halved as they are walked.
    following = np.arange(len(at) + 1)

    def open_from(i: int) -> int:
        while following[i] != i:
            following[i] = following[following[i]]
            i = following[i]
        return i

    for number, (start, end) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        i = open_from(start)
        while i < end:
            winner[i], following[i] = number, i + 1
            i = open_from(i)
    hit = winner >= 0
    out = frames.loc[hit, ["weather_uid", "at"]].reset_index(drop=True)
    return out.assign(label=labels["label"].to_numpy()[winner[hit]])


class SlotWinners(StatefulProcessor):
    """Frames and labels of one place and time slot; when the watermark passes the slot, each covered frame gets its label."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "weather_uid BIGINT, at BIGINT")
        self.labels = handle.getListState("labels", "at BIGINT, seq BIGINT, label STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            frames, labels = batch[batch["kind"] == "frame"], batch[batch["kind"] == "label"]
            if len(frames):
                self.frames.appendList([(int(u), int(a)) for u, a in zip(frames["weather_uid"], frames["at"], strict=True)])
            if len(labels):
                self.labels.appendList(
                    [(int(a), int(s), v) for a, s, v in zip(labels["at"], labels["seq"], labels["label"], strict=True)]
                )
        self.handle.registerTimer((int(key[1]) + 1) * self.seconds * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = pd.DataFrame(list(self.frames.get()), columns=["weather_uid", "at"])
        labels = pd.DataFrame(list(self.labels.get()), columns=["at", "seq", "label"])
        self.frames.clear()
        self.labels.clear()
        won = winners_in(frames, labels, self.seconds * 1_000_000)
        return iter([won] if len(won) else [])

    def close(self) -> None:
        pass


def propagate_winners(rows: DataFrame, delay: str = "10 minutes", seconds: int = SPREAD_SECONDS) -> DataFrame:
    """(weather_uid, at, label): one row per frame that a label covers, with the label of the highest ``seq``.

    ``rows`` is one stream of frames (``seq`` null) and label events, as
    (location, time, weather_uid, seq, label); ``at`` is a frame's time in microseconds. State is kept per
    place and slot of ``seconds`` until the watermark passes the slot, so a
    label that is late by less than ``delay`` still counts; later ones are dropped. A row with neither
    ``seq`` nor ``weather_uid`` only moves the watermark. The session needs ``STATE_STORE``.
    """
    slot = F.floor(F.unix_seconds("time") / F.lit(seconds))
    # A label reaches into its own slot and the next; a frame lies in one.
    slots = F.when(F.col("seq").isNull(), F.array(slot)).otherwise(F.array(slot, slot + 1))
    placed = rows.withWatermark("time", delay).select(
        "location",
        F.explode(slots).alias("_slot"),
        "time",
        micros("time").alias("at"),
        # Integers without nulls reach Python as integers.
        F.coalesce("weather_uid", F.lit(0)).alias("weather_uid"),
        F.coalesce("seq", F.lit(0)).alias("seq"),
        "label",
        F.when(F.col("seq").isNotNull(), "label").when(F.col("weather_uid").isNotNull(), "frame").otherwise("").alias("kind"),
    )
    return placed.groupBy("location", "_slot").transformWithStateInPandas(
        SlotWinners(seconds), "weather_uid BIGINT, at BIGINT, label STRING", "Append", "EventTime"
    )
