"""Time windows over decisions; the same code serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.plans.segmented import BUCKET, dealt, running


def windowed_decisions(events: DataFrame, width: str, slide: str | None = None,
                       watermark: str | None = None) -> DataFrame:
    """Decision counts per tumbling or sliding window; late rows are dropped by the watermark."""
    if watermark:
        events = events.withWatermark("event_time", watermark)
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return events.groupBy(window.alias("w"), "decision").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "decision", "n"
    )


def tenant_sessions(events: DataFrame, gap: str, bucket: str | None = None) -> DataFrame:
    """Per-tenant sessions: bursts of events separated by at least ``gap``.

    Events of a tenant and instant collapse first, and the gaps are found in ranges of even
    size, or per tenant and ``bucket`` of time where no tenant is busy within one, so a busy
    tenant is not one task's work.
    """
    rows = events.groupBy("tenant_id", "event_time").agg(F.count("*").alias("c"))
    width = F.date_trunc(bucket, "event_time") if bucket else None
    rows, edges = dealt(rows, ["tenant_id"], ["event_time"], width)
    dated = running(rows, ["tenant_id"], BUCKET, ["event_time"], befores={"prev": F.col("event_time")}, edges=edges)
    length = F.expr(f"INTERVAL {gap}")
    fresh = F.col("prev").isNull() | (F.col("event_time") >= F.col("prev") + length)
    started = running(
        dated, ["tenant_id"], BUCKET, ["event_time"],
        lasts={"session_start": F.when(fresh, F.col("event_time"))}, edges=edges,
    )
    return started.groupBy("tenant_id", "session_start").agg(
        (F.max("event_time") + length).alias("session_end"), F.sum("c").alias("n")
    )


def tenant_session_stream(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    """The same over a stream; a session is emitted once the watermark has passed it."""
    window = F.session_window("event_time", gap)
    counted = events.withWatermark("event_time", watermark).groupBy("tenant_id", window.alias("w")).agg(
        F.count("*").alias("n")
    )
    return counted.select("tenant_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
