import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions.pieces import Stretch, composed, constant, identity
from auditlake.operators import quota


def brute(calls, rate, burst, period):
    state, out = {}, {}
    for order, key, ms in sorted(calls, key=lambda c: (c[2], c[0])):
        level, at = state.get(key, (burst * period, ms))
        level = min(burst * period, level + (ms - at) * rate)
        allowed = level >= period
        level -= period if allowed else 0
        state[key] = (level, ms)
        out[order] = (allowed, -(-max(0, period - level) // rate))
    return out


def run(spark, calls, rate, burst, period):
    rows = spark.createDataFrame(calls, "id int, tenant_id string, ms bigint").select(
        "id", "tenant_id", F.lit("/v1/x").alias("path"), F.timestamp_millis("ms").alias("ts"))
    limited = quota.rate_limit(rows, "id", rate, burst, period)
    return {r.id: (r.allowed, r.retry_ms) for r in limited.collect()}


def test_one_call(spark):
    assert run(spark, [(1, "a", 1000), (2, "a", 1000)], 1, 1, 1000) == {1: (True, 1000), 2: (False, 1000)}


@pytest.mark.parametrize("rate,burst,period,spread", [
    (60, 5, 1000, 20_000), (60, 120, 1000, 3_000), (1, 3, 3_600_000, 50_000_000), (7, 4, 1000, 200_000), (3, 2, 1000, 900_000),
])
@pytest.mark.parametrize("chunk", [1_000, 60_000])
def test_equals_brute_force(spark, monkeypatch, rate, burst, period, spread, chunk):
    monkeypatch.setattr(quota, "CHUNK_MS", chunk if period == 1000 else chunk * 1000)
    monkeypatch.setattr(quota, "CHUNK_ROWS", 20 if chunk == 1_000 else 300)
    monkeypatch.setattr(quota, "BLOCK_CHUNKS", 5)
    rng = random.Random(rate * chunk + burst)
    # One key makes most calls and never pauses; others are quiet.
    calls = [(i, rng.choice(["hot", "hot", "hot", "b", "c"]), rng.randrange(spread)) for i in range(1500)]
    assert run(spark, calls, rate, burst, period) == brute(calls, rate, burst, period)


def steps(rng, n, reach, calls):
    times = sorted(rng.sample(range(100, 100 + reach), n))
    return [(now - before, rng.randint(1, calls)) for before, now in zip([90, *times], times)]


def followed(level, calls, rate, full, period):
    for pause, n in calls:
        level = min(full, level + pause * rate)
        level -= min(n, level // period) * period
    return level


def stretch(calls, rate, full, period, pieces=None):
    whole = Stretch(pieces or identity(), full, period)
    for pause, n in calls:
        whole.refill(pause * rate)
        whole.take(n)
    return whole.now()


@pytest.mark.parametrize("seed", range(60))
def test_functions_follow_every_level(seed):
    rng = random.Random(seed)
    rate, burst, period = rng.randint(1, 9), rng.randint(1, 9), rng.randint(1, 30)
    full, n = burst * period, rng.randint(1, 60)
    calls = steps(rng, n, rng.choice([n, 3 * n, 20 * n]), rng.choice([1, 3, 2 * burst]))
    whole = stretch(calls, rate, full, period)
    for level in range(full + 1):
        assert whole(level) == followed(level, calls, rate, full, period)
    assert stretch(calls, rate, full, period, constant(full))(0) == followed(full, calls, rate, full, period)


@pytest.mark.parametrize("seed", range(30))
def test_composition_is_associative(seed):
    rng = random.Random(seed)
    rate, burst, period = rng.randint(1, 5), rng.randint(1, 6), rng.randint(1, 25)
    full = burst * period
    calls = [steps(rng, 8, 60, 3) for _ in range(3)]
    a, b, c = (stretch(part, rate, full, period) for part in calls)
    left, right = composed(composed(a, b, full), c, full), composed(a, composed(b, c, full), full)
    whole = sum(calls, [])
    for level in range(full + 1):
        assert left(level) == right(level) == followed(level, whole, rate, full, period)


def test_size_does_not_follow_levels():
    """A billion levels, 50 tokens: the functions stay as small as the bucket has tokens."""
    rng = random.Random(5)
    burst, period = 50, 20_000_000
    for rate in (1, 1000, 200_000):
        whole = stretch([(rng.randint(1, 100), rng.randint(1, 3)) for _ in range(20_000)], rate, burst * period, period)
        assert len(whole.lo) <= 4 * burst


def test_hot_key_is_dealt_to_several_tasks(spark, monkeypatch):
    """A key that never pauses: its levels come from chunks of 100 instants, over several blocks."""
    monkeypatch.setattr(quota, "CHUNK_ROWS", 100)
    monkeypatch.setattr(quota, "BLOCK_CHUNKS", 4)
    seen = []
    real = quota._chunk_starts
    monkeypatch.setattr(quota, "_chunk_starts", lambda f, full: seen.append(f.count()) or real(f, full))
    rng = random.Random(11)
    calls = [(i, "hot", rng.randrange(30_000_000)) for i in range(2000)]
    assert run(spark, calls, 1, 3, 3_600_000) == brute(calls, 1, 3, 3_600_000)
    assert seen == [-(-len({ms for _, _, ms in calls}) // 100)]
