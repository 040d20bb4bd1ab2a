"""Streaming dedup of replayed events."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stream_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event per event_id; replays within ``delay`` of it are dropped, state is bounded."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
