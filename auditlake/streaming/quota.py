"""Streaming token bucket with one state value per tenant and path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditlake.operators.quota import BURST, PERIOD_MS, RATE

OUTPUT = "key string, request_id string, ms bigint, allowed boolean, retry_ms bigint"


class TokenBucket(StatefulProcessor):
    def __init__(self, rate: int, burst: int, period_ms: int, expires: bool):
        self.rate, self.burst, self.period_ms, self.expires = rate, burst, period_ms, expires
        self.refill_ms = -(-burst * period_ms // rate)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "level bigint, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "request_id"], kind="stable")
        full, cost = self.burst * self.period_ms, self.period_ms
        known = self.state.exists()
        level, at = self.state.get() if known else (full, None)
        allowed, wait = [], []
        for ms in frame["ms"]:
            if at is not None:
                level = min(full, level + max(0, int(ms) - at) * self.rate)
            at = int(ms)
            ok = level >= cost
            level -= cost if ok else 0
            allowed.append(ok)
            wait.append(-(-max(0, cost - level) // self.rate))
        self.state.update((level, at))
        if self.expires and not known:
            self.handle.registerTimer(at + self.refill_ms)
        yield pd.DataFrame({
            "key": key[0], "request_id": frame["request_id"], "ms": frame["ms"],
            "allowed": allowed, "retry_ms": wait,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forgets a bucket that is full again; one that was used since is looked at later."""
        full_at = self.state.get()[1] + self.refill_ms
        if full_at <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        else:
            self.handle.registerTimer(full_at)
        return iter([])

    def close(self) -> None:
        pass


def stream_rate_limit(requests: DataFrame, rate: int = RATE, burst: int = BURST,
                      period_ms: int = PERIOD_MS, late: str | None = None) -> DataFrame:
    """Requests (request_id, tenant_id, path, ts) -> allowed and retry_ms, in arrival order.

    With ``late``, how far calls may come out of order, the bucket of a key is forgotten once the
    watermark has passed the time at which it is full again, so state follows the active keys and
    results stay the same. A call that is later than that is not dropped; it may meet a full bucket.
    """
    requests = requests if late is None else requests.withWatermark("ts", late)
    keyed = requests.select(
        F.concat_ws(":", "tenant_id", "path").alias("key"), "request_id", F.unix_millis("ts").alias("ms")
    )
    return keyed.groupBy("key").transformWithStateInPandas(
        TokenBucket(rate, burst, period_ms, late is not None), outputStructType=OUTPUT, outputMode="Append",
        timeMode="None" if late is None else "EventTime",
    )
