"""Running values over ranges of even row count, where one key and hour holds nearly all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditlake.operators import metrics as met
from auditlake.operators import policy as pol
from auditlake.operators import timeline, windows
from auditlake.plans.segmented import BUCKET, dealt, running

START = datetime(2024, 1, 1)


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hot(n, seed, quiet=20):
    """(key, microsecond) pairs: all but a few of one key, within one hour."""
    rng = random.Random(seed)
    times = rng.sample(range(3_600_000_000), n - quiet)
    return [("hot", t) for t in times] + [(rng.choice("bcz"), i * 7_200_000_000) for i in range(quiet)]


def test_ranges_are_even_and_ordered(spark, many_ranges):
    frame = spark.createDataFrame(hot(20_000, 1), "k string, t bigint")
    rows, edges = dealt(frame, ["k"], ["t"])
    found = rows.groupBy(BUCKET).agg(
        F.count("*").alias("n"), F.min(F.struct("k", "t")).alias("a"), F.max(F.struct("k", "t")).alias("b")
    ).orderBy(BUCKET).collect()
    assert sum(r.n for r in found) == 20_000 and max(r.n for r in found) < 3 * 20_000 / 24
    assert all(x.b < y.a for x, y in zip(found, found[1:]))
    held = {(r.k, r[BUCKET]) for r in rows.select("k", BUCKET).distinct().collect()}
    several = {k for k, b in held if sum(k == j for j, _ in held) > 1}
    assert {(r.k, r[BUCKET]) for r in edges.collect()} == {(k, b) for k, b in held if k in several}


@pytest.mark.parametrize("seed", range(4))
def test_running_values_over_ranges(spark, many_ranges, seed):
    rng = random.Random(seed)
    rows = [(k, t, rng.choice([None, None, rng.randint(0, 9)])) for k, t in hot(400, seed, quiet=[20, 0, 200, 399][seed])]
    frame = spark.createDataFrame(rows, "k string, t bigint, v int")
    value = F.col("v")
    dealt_rows, edges = dealt(frame, ["k"], ["t"])
    got = running(dealt_rows, ["k"], BUCKET, ["t"], sums={"s": value}, lasts={"l": value}, befores={"p": value},
                  nexts={"x": value}, edges=edges)
    got = {(r.k, r.t): (r.s, r.l, r.p, r.x) for r in got.collect()}
    assert len(got) == len({(k, t) for k, t, _ in rows})
    for k, t, _ in rows:
        line = sorted((u, w) for j, u, w in rows if j == k and w is not None)
        upto, before, after = [w for u, w in line if u <= t], [w for u, w in line if u < t], [w for u, w in line if u > t]
        assert got[k, t] == (sum(upto), upto[-1] if upto else None, before[-1] if before else None, after[0] if after else None)


def test_no_rows(spark):
    rows, edges = dealt(spark.createDataFrame([], "k string, t int"), ["k"], ["t"])
    assert running(rows, ["k"], BUCKET, ["t"], sums={"s": F.lit(1)}, edges=edges).count() == 0


def test_input_is_not_read_again(spark):
    """What follows the write reads the ranges alone, however many running values there are."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(1000).mapInArrow(count, "id bigint").select(F.lit("k").alias("k"), "id")
    rows, edges = dealt(frame, ["k"], ["id"])
    written = seen.value
    one = running(rows, ["k"], BUCKET, ["id"], sums={"s": F.col("id")}, edges=edges)
    two = running(one, ["k"], BUCKET, ["id"], lasts={"l": F.col("s")}, edges=edges)
    assert two.count() == 1000 and two.agg(F.max("l")).first()[0] == 499_500
    assert written <= 2000 and seen.value == written


def test_outages_of_one_busy_auditor(spark, many_ranges):
    rng = random.Random(5)
    calls = [(k, START + timedelta(microseconds=t), i, rng.choice(["", "x", "x", "x", "x", "x", "x", met.CIRCUIT_OPEN]))
             for i, (k, t) in enumerate(hot(3000, 5))]
    want, runs = set(), {}
    for k, ts, i, error in sorted(calls, key=lambda c: (c[0], c[1], c[2])):
        if error == met.CIRCUIT_OPEN:
            continue
        runs[k] = runs.get(k, 0) + 1 if error else 0
        if error and runs[k] % met.OUTAGE_FAILURES == 0:
            want.add((k, ts, runs[k] // met.OUTAGE_FAILURES))
    found = met.auditor_outages(spark.createDataFrame(calls, "auditor string, ts timestamp, seq int, error string"))
    assert {(r.auditor, r.opened_at, r.nth_in_run) for r in found.collect()} == want and len(want) > 100


def test_ranges_equal_buckets(spark, many_ranges):
    """Each operator gives over ranges what it gives over buckets of time."""
    rng = random.Random(9)
    base = [(k, START + timedelta(microseconds=t), i, rng.random() < 0.9) for i, (k, t) in enumerate(hot(1500, 9))]
    frame = spark.createDataFrame(base, "series string, ts timestamp, seq int, firing boolean")
    hour = F.date_trunc("hour", "ts")

    def same(a, b):
        assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr) and a.count() > 0

    same(met.alert_for(frame, F.lit(3)), met.alert_for(frame, F.lit(3), hour))
    events = frame.select(F.col("series").alias("tenant_id"), F.col("ts").alias("event_time"))
    same(windows.tenant_sessions(events, "5 seconds"), windows.tenant_sessions(events, "5 seconds", "hour"))
    changes = frame.select(F.col("series").alias("scope"), "ts", F.col("seq").alias("version"))
    same(timeline.rule_set_timeline(changes), timeline.rule_set_timeline(changes, hour))
    probes = frame.select(F.col("series").alias("scope"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), "seq")
    same(timeline.rules_asof(probes, changes), timeline.rules_asof(probes, changes, hour))
    same(pol.policy_timeline(frame, ["series"], ["ts", "seq"]), pol.policy_timeline(frame, ["series"], ["ts", "seq"], hour))


def test_many_probes_of_one_instant_fill_several_ranges(spark, many_ranges, monkeypatch):
    changes = spark.createDataFrame([("g", START, 1), ("g", START + timedelta(1), 2)], "scope string, ts timestamp, version int")
    probes = spark.range(5000).select(F.lit("g").alias("scope"), F.lit(START).alias("ts"), "id", F.create_map("id", "id").alias("m"))
    kept = {}

    def spy(*args):
        kept["rows"], kept["edges"] = dealt(*args)
        return kept["rows"], kept["edges"]

    monkeypatch.setattr(timeline, "dealt", spy)
    found = timeline.rules_asof(probes, changes)
    assert found.filter("rule_version = 1").count() == 5000
    assert max(r["count"] for r in kept["rows"].groupBy(BUCKET).count().collect()) < 3 * 5000 / 24
