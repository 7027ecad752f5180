"""Streaming forms of the window operators over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per tumbling window; events later than `late` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions parted by gaps, of which the shortest is `gap`. Events later than `late` are
    left out; with None, none is."""
    events = events if late is None else events.withWatermark("ts", late)
    # Spark's windows go on over a gap of just their length
    s = events.groupBy(F.session_window("ts", f"{gap} -1 microseconds"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), (F.col("session_window.end") + F.expr("interval 1 microsecond")).alias("end"), "n")


def occurrence_numbers(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, occurrence): each key's running number, which goes on from batch to batch."""

    def number(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for b in batches:
            b = b.sort_values(["ts", "event_id"])
            yield pd.DataFrame({key: k[0], "event_id": b["event_id"], "occurrence": range(seen, seen + len(b))})
            seen += len(b)
        state.update((seen,))

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(number, f"{key} long, event_id long, occurrence long", "seen long", "append", GroupStateTimeout.NoTimeout)
