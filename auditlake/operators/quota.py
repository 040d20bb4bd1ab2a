"""Token bucket over a request log: which calls were over quota, and how long to wait."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions.pieces import Pieces, Stretch, composed, constant, identity
from auditlake.functions.text import endpoint_bucket
from auditlake.plans.segmented import running
from auditlake.sources.sink import materialize

RATE, BURST, PERIOD_MS = 60, 120, 1000
CHUNK_MS = 3_600_000
# Instants of a session that one task follows, and chunks whose functions one task composes.
CHUNK_ROWS, BLOCK_CHUNKS = 4096, 64


def scan_chunks(frames: Iterator[pd.DataFrame], rate: int, burst: int, period_ms: int) -> Iterator[pd.DataFrame]:
    """Token level before each instant, over rows sorted by key, session, chunk and time.

    Levels are integers in units of 1/period_ms token, so refill is exact. A chunk starts
    from its ``start`` level at time ``prev``, or with a full bucket. One level is kept, so
    memory does not grow with the length of a chunk.
    """
    full, group, level, at = burst * period_ms, None, 0, 0
    for frame in frames:
        levels = []
        columns = (frame[c] for c in ("key", "session", "chunk", "ms", "n", "prev", "start"))
        for key, session, chunk, ms, n, prev, start in zip(*columns):
            if (key, session, chunk) != group:
                group = (key, session, chunk)
                level = full if start < 0 else min(full, start + (ms - prev) * rate)
            else:
                level = min(full, level + (ms - at) * rate)
            at = ms
            levels.append(level)
            level -= min(n, level // period_ms) * period_ms
        yield frame[["key", "session", "ms", "n"]].assign(level=levels)


def chunk_functions(frames: Iterator[pd.DataFrame], rate: int, burst: int, period_ms: int) -> Iterator[pd.DataFrame]:
    """One row per chunk of rows sorted by key, session, chunk and time: its end level as a function
    (``lo``, ``at``, ``slope`` of ``Pieces``) of the level its session had at ``prev``.

    The first chunk of a session (``opens``) starts from a full bucket, so its function is constant.
    """
    full, group, stretch, at = burst * period_ms, None, None, 0
    for frame in frames:
        done = []
        columns = (frame[c] for c in (*_CHUNK, "ms", "n", "prev", "opens"))
        for key, session, chunk, ms, n, prev, opens in zip(*columns):
            if (key, session, chunk) != group:
                if group is not None:
                    done.append((*group, *stretch.now()))
                group, at = (key, session, chunk), ms if opens else prev
                stretch = Stretch(constant(full) if opens else identity(), full, period_ms)
            stretch.refill((ms - at) * rate)
            stretch.take(n)
            at = ms
        if done:
            yield pd.DataFrame(done, columns=_FUNCTION)
    if group is not None:
        yield pd.DataFrame([(*group, *stretch.now())], columns=_FUNCTION)


def _pieces(frame: pd.DataFrame) -> Iterator[Pieces]:
    for row in zip(frame["lo"], frame["at"], frame["slope"]):
        yield Pieces(*(np.asarray(values, np.int64) for values in row))


def block_functions(frames: Iterator[pd.DataFrame], full: int) -> Iterator[pd.DataFrame]:
    """One row per key, session and block: its chunks' functions composed, over rows sorted by these and chunk."""
    group, function = None, None
    for frame in frames:
        done = []
        for key, session, block, pieces in zip(frame["key"], frame["session"], frame["block"], _pieces(frame)):
            if (key, session, block) != group:
                if group is not None:
                    done.append((*group, *function))
                group, function = (key, session, block), pieces
            else:
                function = composed(function, pieces, full)
        if done:
            yield pd.DataFrame(done, columns=_FUNCTION)
    if group is not None:
        yield pd.DataFrame([(*group, *function)], columns=_FUNCTION)


def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Level before each row's function, over rows in order whose first function is constant in every group."""
    level = 0
    for frame in frames:
        found = []
        for pieces in _pieces(frame):
            found.append(level)
            level = pieces(level)
        yield frame[_CHUNK].assign(start=found)


_CHUNK = ["key", "session", "chunk"]
_FUNCTION = [*_CHUNK, "lo", "at", "slope"]
_FUNCTION_TYPE = "key string, session bigint, chunk bigint, lo array<bigint>, at array<bigint>, slope array<bigint>"
_START_TYPE = "key string, session bigint, chunk bigint, start bigint"
# Sorts before every chunk.
_OPENING = -(2**62)


def _chunk_starts(functions: DataFrame, full: int) -> DataFrame:
    """(key, session, chunk) -> level at the end of the chunk before.

    A session is followed block by block, a block chunk by chunk, each in a task of its own: a task
    sees the blocks of a session or the chunks of a block, never a session's chunks or instants.
    """
    blocked = functions.withColumn("block", F.floor(F.col("chunk") / BLOCK_CHUNKS))
    by_block = blocked.repartition("key", "session", "block").sortWithinPartitions("key", "session", "block", "chunk")
    blocks = by_block.mapInPandas(lambda frames: block_functions(frames, full), _FUNCTION_TYPE)
    followed = blocks.repartition("key", "session").sortWithinPartitions(*_CHUNK).mapInPandas(starts, _START_TYPE)
    zero = F.array(F.lit(0).cast("bigint"))
    opening = followed.select(
        "key", "session", F.lit(_OPENING).cast("bigint").alias("chunk"), zero.alias("lo"),
        F.array("start").alias("at"), zero.alias("slope"), F.col("chunk").alias("block"),
    )
    both = blocked.unionByName(opening).repartition("key", "session", "block")
    found = both.sortWithinPartitions("key", "session", "block", "chunk").mapInPandas(starts, _START_TYPE)
    return found.filter(F.col("chunk") != _OPENING)


def _scan(rows: DataFrame, rate: int, burst: int, period_ms: int) -> DataFrame:
    ordered = rows.repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, "ms")
    return ordered.mapInPandas(
        lambda frames: scan_chunks(frames, rate, burst, period_ms),
        "key string, session bigint, ms bigint, n bigint, level bigint",
    )


def bucket_levels(calls: DataFrame, rate: int, burst: int, period_ms: int) -> DataFrame:
    """(key, ms) -> token level met by the first call of that millisecond.

    Calls of one key and millisecond collapse into one row before anything is shuffled by
    key. A pause long enough to refill the bucket makes what follows independent of what came
    before, so keys are split into sessions there. A session of more than CHUNK_ROWS instants is
    split too: each chunk becomes a piecewise-linear function of the level it starts from, the
    functions are composed, and all chunks are then scanned side by side.
    """
    instants = calls.groupBy("key", "ms").agg(F.count("*").alias("n"))
    hours = instants.withColumn("hour", F.floor(F.col("ms") / CHUNK_MS))
    refill_ms = -(-burst * period_ms // rate)
    one = F.lit(1).cast("bigint")
    gaps = running(hours, ["key"], "hour", ["ms"], sums={"nth": one}, befores={"prev": F.col("ms")})
    fresh = F.col("prev").isNull() | (F.col("ms") - F.col("prev") >= refill_ms)
    opened = {"session": F.when(fresh, F.col("ms")), "opened": F.when(fresh, F.col("nth"))}
    sessions = running(gaps, ["key"], "hour", ["ms"], lasts=opened)
    chunk = F.floor((F.col("nth") - F.col("opened")) / CHUNK_ROWS)
    rows = sessions.select(
        "key", "session", chunk.alias("chunk"), "ms", "n", F.coalesce("prev", "ms").alias("prev"), (chunk == 0).alias("opens")
    )
    stored = materialize(rows, "instants")
    first = stored.filter("opens").withColumn("start", F.lit(-1).cast("bigint"))
    rest = stored.filter("not opens")
    levels = _scan(first, rate, burst, period_ms)
    if not rest.isEmpty():
        long = rest.select("key", "session").distinct()
        ordered = stored.join(long, ["key", "session"], "left_semi").repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, "ms")
        functions = ordered.mapInPandas(lambda frames: chunk_functions(frames, rate, burst, period_ms), _FUNCTION_TYPE)
        found = _chunk_starts(materialize(functions, "chunks"), burst * period_ms)
        levels = levels.unionByName(_scan(rest.join(found, _CHUNK), rate, burst, period_ms))
    return levels.select("key", "ms", "level")


def retry_ms(level: Column, rate: int, period_ms: int) -> Column:
    """Milliseconds until one token is there again, rounded up."""
    return F.ceil(F.greatest(F.lit(0), F.lit(period_ms) - level) / F.lit(rate)).cast("bigint")


def rate_limit(requests: DataFrame, order: str, rate: int = RATE, burst: int = BURST,
               period_ms: int = PERIOD_MS) -> DataFrame:
    """Adds allowed and retry_ms: ``rate`` tokens per ``period_ms``, at most ``burst`` held.

    Needs tenant_id, path, ts and ``order``, which ranks calls of the same millisecond. The
    level falls on allowed calls only; time advances on refused ones too.
    """
    keyed = requests.withColumns(
        {"key": F.concat_ws(":", "tenant_id", "path"), "ms": F.unix_millis("ts")}
    )
    levels = bucket_levels(keyed.select("key", "ms"), rate, burst, period_ms)
    joined = keyed.join(levels, ["key", "ms"])
    # The n-th call of a millisecond takes the n-th whole token, while there is one.
    nth = F.row_number().over(W.partitionBy("key", "ms").orderBy(order)).cast("bigint")
    tokens = F.floor(F.col("level") / period_ms)
    left = F.col("level") - F.least(F.col("__nth"), tokens) * period_ms
    return joined.withColumn("__nth", nth).select(
        *requests.columns, (F.col("__nth") <= tokens).alias("allowed"),
        retry_ms(left, rate, period_ms).alias("retry_ms"),
    )


def quota_report(limited: DataFrame) -> DataFrame:
    """Refusals per endpoint and the longest advertised wait (whole seconds, at least 1)."""
    wait = F.greatest(F.lit(1), F.floor(F.col("retry_ms") / 1000).cast("bigint"))
    refused = ~F.col("allowed")
    return limited.groupBy(endpoint_bucket(F.col("path")).alias("endpoint")).agg(
        F.count("*").alias("requests"), F.count_if(refused).alias("rejected"),
        F.max(F.when(refused, wait)).alias("max_wait_s"),
    )
