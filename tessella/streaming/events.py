"""Structured Streaming over interaction events. An extension: append, windows, reinforcement state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.model import BOOSTS, EVENT_KINDS

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as repeats are at most ``late`` behind."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and sum of values by type and window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _reinforce(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import math

    n, s = state.get if state.exists else (0, 1.0)
    for f in frames:
        for kind in f.sort_values(["ts", "event_id"])["event_type"]:
            boost = BOOSTS.get(EVENT_KINDS.get(kind, ""), None)
            if boost is not None:
                n += 1
                s = min(100.0, s + (min(s, 1.0) + boost) * math.log1p(1.0 / n))
    state.update((n, s))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "stability": [s]})


def reinforcement(events: DataFrame) -> DataFrame:
    """The stability of each user's memory after every batch of interactions."""
    return events.groupBy("user_id").applyInPandasWithState(_reinforce, "user_id long, n long, stability double", "n long, stability double", "update", GroupStateTimeout.NoTimeout)
