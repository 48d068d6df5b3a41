"""Streaming forms: totals by event-time window, and retry cooldowns as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stackwright.operators.monitor import BACKOFF_MINUTES


def window_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """(start, key, n): counts by tumbling window; rows later than ``late`` drop out."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def cooldowns(failures: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, attempts, retry_after): each batch's failures raise the attempts and set a new cooldown."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts = state.get[0] if state.exists else 0
        last = None
        for b in batches:
            attempts += len(b)
            newest = b[ts].max()
            last = newest if last is None or newest > last else last
        state.update((attempts,))
        wait = BACKOFF_MINUTES[min(attempts - 1, 2)]
        yield pd.DataFrame({key: [k[0]], "attempts": [attempts], "retry_after": [last + pd.Timedelta(minutes=wait)]})

    return failures.groupBy(key).applyInPandasWithState(run, f"{key} long, attempts long, retry_after timestamp", "attempts long", "update", GroupStateTimeout.NoTimeout)
