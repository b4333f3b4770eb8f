"""Stateful operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_ttl(events: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """Keys and the number of events that they had while none passed: one row each time a key passes. A key's state ends with
    its time to live, by the clock."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = sum(len(p) for p in parts)
        if not state.exists:
            state.update((True,))
            state.setTimeoutDuration(ttl_seconds * 1000)
            yield pd.DataFrame({**dict(zip(keys, ([k] for k in key), strict=True)), "events": [n]})

    kinds = dict(events.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", events long"
    return events.groupBy(*keys).applyInPandasWithState(run, schema, "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def dedup_event_time(events: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def counters(outcomes: DataFrame, ts: str, window: str, delay: str) -> DataFrame:
    """Events by outcome and window of time."""
    return outcomes.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), "outcome").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "outcome", "events")
