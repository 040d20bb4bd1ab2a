"""Rolling channel windows over a stream of SSE fragments, ended at the first block."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditlake.operators.sse import WINDOW_BYTES, stream_keys

#: Event time after which a silent stream's window tails are dropped, unless a caller says otherwise.
IDLE_MS = 600_000
#: Columns of a fragment; times travel as numbers, as a Row's times depend on the worker's zone.
FRAGMENT = ["stream", "request_id", "tenant_id", "path", "seq", "frag", "channel", "fragment", "us"]
OUTPUT = "stream string, request_id string, tenant_id string, path string, seq int, frag int, channel string, fragment binary, window binary, us bigint"
WINDOW = Row(*FRAGMENT[:-1], "window", "us")


def in_order(rows: Iterator[Row], seq: int, frag: int) -> list[Row]:
    """Rows of one stream by the columns at ``seq`` and ``frag``, nulls last."""
    return sorted(rows, key=lambda r: (r[seq] is None, r[seq] or 0, r[frag] is None, r[frag] or 0))


def renew(handle: StatefulProcessorHandle, deadline, at: int, known: bool) -> None:
    """Move the one timer of a stream, which drops its state when it fires."""
    if known:
        handle.deleteTimer(deadline.get()[0])
    deadline.update((at,))
    handle.registerTimer(at)


class ChannelWindows(StatefulProcessor):
    """Per stream: the last W bytes of every channel; dropped after ``idle_ms`` of silence in event time."""

    def __init__(self, window: int = WINDOW_BYTES, idle_ms: int = IDLE_MS):
        self.window, self.idle_ms = window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tails = handle.getMapState("tails", "channel string", "tail binary")
        self.deadline = handle.getValueState("deadline", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.deadline.exists()
        tails: dict[str, bytes] = {}
        latest, windows = None, []
        for row in in_order(rows, 4, 5):
            *head, channel, fragment, us, _ = row
            if channel not in tails:
                tail = self.tails.getValue((channel,)) if known and self.tails.containsKey((channel,)) else (b"",)
                tails[channel] = bytes(tail[0])
            data = tails[channel] + bytes(fragment)
            windows.append(WINDOW(*head, channel, fragment, data, us))
            tails[channel] = data[-self.window:]
            latest = us if latest is None else max(latest, latest if us is None else us)
        for channel, tail in tails.items():
            self.tails.updateValue((channel,), (tail,))
        # Fragments without any time leave their stream silent from the watermark on.
        at = timerValues.getCurrentWatermarkInMs() if latest is None else latest // 1000
        renew(self.handle, self.deadline, at + self.idle_ms, known)
        return iter(windows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tails.clear()
        self.deadline.clear()
        return iter([])

    def close(self) -> None:
        pass


def _by_stream(rows: DataFrame) -> DataFrame:
    """Adds ``stream``, the capture a row belongs to (its request where the capture has no id)."""
    return rows.withColumn("stream", F.col(stream_keys(rows)[0]))


def stream_windows(fragments: DataFrame, window: int = WINDOW_BYTES, delay: str = "10 minutes",
                   idle_ms: int = IDLE_MS) -> DataFrame:
    """Fragments (request_id, ..., event_time) -> fragments with their window.

    After ``idle_ms`` without a fragment a stream's tails are dropped: a term split over a longer
    pause is found by the batch form only. A late fragment gets the window of its arrival.
    Needs the RocksDB state store. Auditing and the cut follow as ordinary projections, so
    the rules stay in the JVM.
    """
    rows = _by_stream(fragments).withWatermark("event_time", delay).withColumn("us", F.unix_micros("event_time"))
    found = rows.select(*FRAGMENT, "event_time").groupBy("stream").transformWithState(
        ChannelWindows(window, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return found.withColumn("event_time", F.timestamp_micros("us")).drop("us")


CUT_COLUMNS = ["stream", "request_id", "seq", "frag", "channel", "risk_score", "decision"]
CUT_ROW = Row(*CUT_COLUMNS)
CUT = "stream string, request_id string, seq int, frag int, channel string, risk_score int, decision string"


class FirstBlock(StatefulProcessor):
    """Per stream: passes audited fragments up to and including the first blocked one.

    That a stream has ended is kept for good, one number for each blocked stream: nothing of it
    passes later, however long the pause.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "seq int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = []
        if self.ended.exists():
            return iter(passed)
        for row in in_order(rows, 2, 3):
            passed.append(CUT_ROW(*row[:-1]))
            if row[6] == "block":
                self.ended.update((row[2],))
                break
        return iter(passed)

    def close(self) -> None:
        pass


def stream_until_block(audited: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Audited fragments -> those that were still read before their stream ended."""
    rows = audited if "stream" in audited.columns else _by_stream(audited)
    return rows.select(*CUT_COLUMNS, "event_time").withWatermark("event_time", delay).groupBy("stream").transformWithState(FirstBlock(), outputStructType=CUT, outputMode="Append", timeMode="EventTime")


def configure(spark) -> None:
    """State with timers and maps needs the RocksDB store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
