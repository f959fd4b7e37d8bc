"""Rows of a stream that come again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "30 days") -> DataFrame:
    """The row of each key that comes first; others go for as long as the state keeps the key: until the watermark, which follows
    the latest event time by `late`, has passed that row by `late`. So the state holds the keys of a bounded time, and a key that
    comes again later is told again."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
