"""Two-level running values, alerts, outages, keys: against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditlake.operators import identity
from auditlake.operators import metrics as met
from auditlake.operators import timeline, windows
from auditlake.plans.lookup import busy_groups, lookup, salted_lookup
from auditlake.plans.segmented import running

START = datetime(2024, 1, 1)


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), t, rng.choice([None, rng.randint(0, 9)])) for t in rng.sample(range(500), 200)]
    frame = spark.createDataFrame(rows, "k string, t int, v int").withColumn("b", F.floor(F.col("t") / 20))
    value = F.col("v")
    got = running(frame, ["k"], "b", ["t"], sums={"s": value}, lasts={"l": value}, befores={"p": value}, nexts={"x": value})
    got = {(r.k, r.t): (r.s, r.l, r.p, r.x) for r in got.collect()}
    assert len(got) == 200
    for k, t, _ in rows:
        line = sorted((u, w) for j, u, w in rows if j == k and w is not None)
        upto, before, after = [w for u, w in line if u <= t], [w for u, w in line if u < t], [w for u, w in line if u > t]
        want = (sum(upto), upto[-1] if upto else None, before[-1] if before else None, after[0] if after else None)
        assert got[k, t] == want


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("hot")).alias("k"))
    table = spark.createDataFrame([("hot", 1)], "k string, v int")
    found = salted_lookup(rows, table, ["k"], F.col("id"))
    assert found.count() == 1000 and found.filter("v = 1").count() == rows.filter("k = 'hot'").count()


def test_only_busy_keys_are_repeated(spark):
    quiet = spark.range(10_000).select(F.concat(F.lit("k"), F.col("id") % 1000).alias("k"), "id")
    hot = spark.range(8000).select(F.when(F.col("id") < 5000, "hot").alias("k"), (F.col("id") + 10_000).alias("id"))
    table = quiet.select("k").distinct().unionByName(spark.createDataFrame([("hot",)], "k string")).withColumn("v", F.lit(1))
    rows = quiet.unionByName(hot)
    busy = busy_groups(rows, ["k"])
    assert len(busy) == 2
    found = lookup(rows, table, ["k"], F.col("id"), max_bytes=0)
    assert (found.count(), found.select("id").distinct().count(), found.filter("v = 1").count()) == (18_000, 18_000, 15_000)
    # A right join without matches shows the rows of the table that were sent.
    sent = lookup(rows, table.withColumn("k", F.concat(F.lit("x"), "k")), ["k"], F.col("id"), "right", max_bytes=0)
    assert sent.count() < 1100
    # Keys of two types are not hashed alike.
    whole = spark.createDataFrame([(1, "a")], "k int, v string")
    assert lookup(spark.range(3).withColumnRenamed("id", "k"), whole, ["k"], F.col("k"), max_bytes=0).filter("v = 'a'").count() == 1


def test_outage_after_five_failures(spark):
    def calls(errors):
        return [("a", START + timedelta(seconds=i), i, e) for i, e in enumerate(errors)]

    def outages(errors):
        frame = spark.createDataFrame(calls(errors), "auditor string, ts timestamp, seq int, error string")
        return [r.opened_at.second for r in met.auditor_outages(frame, F.date_trunc("minute", "ts")).orderBy("opened_at").collect()]

    assert outages(["x"] * 5) == [4]
    assert outages(["x"] * 4 + [""] + ["x"] * 4) == []
    assert outages(["x"] * 3 + [met.CIRCUIT_OPEN] + ["x"] * 7) == [5, 10]


def test_alert_needs_an_unbroken_run(spark):
    rows = [("s", START + timedelta(seconds=30 * i), i, i not in (3, 9)) for i in range(12)]
    frame = spark.createDataFrame(rows, "series string, ts timestamp, seq int, firing boolean")
    found = met.alert_for(frame, F.lit(120), F.date_trunc("minute", "ts")).collect()
    assert [(r.started, r.samples) for r in found] == [(START + timedelta(seconds=120), 5)]


def test_readiness(spark):
    schema = "component string, required boolean, status string, checked_at timestamp, seq int"
    ready = [("db", True, "error", START, 0), ("db", True, "ok", START + timedelta(1), 1), ("opt", False, "error", START, 2)]
    assert met.readiness_rollup(spark.createDataFrame(ready, schema)).first().status == "ready"
    down = [("db", True, "disabled", START + timedelta(2), 3)]
    assert met.readiness_rollup(spark.createDataFrame(ready + down, schema)).first().status == "not_ready"


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [0.5] * 90 + [7.0] * 10, [i / 7 for i in range(101)]])
def test_exact_percentile(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    want = frame.agg(F.percentile("v", 0.95)).first()[0]
    assert met.exact_percentile(frame, "v", 0.95, 0.1).first()[0] == pytest.approx(want)


def test_rules_asof_edges(spark):
    changes = spark.createDataFrame([("g", START, 1), ("g", START, 3), ("g", START + timedelta(40), 2)], "scope string, ts timestamp, version int")
    probes = spark.createDataFrame(
        [("g", START - timedelta(1), 0), ("g", START, 1), ("g", START + timedelta(39), 2), ("g", START + timedelta(400), 3), ("h", START, 4)],
        "scope string, ts timestamp, id int")
    found = timeline.rules_asof(probes, changes, F.date_trunc("month", "ts")).orderBy("id").collect()
    assert [r.rule_version for r in found] == [None, 3, 3, 2, None]


def test_credentials(spark):
    from auditlake.functions.digest import hmac_sha256

    uuid = "0b5e4c3a-1111-4222-8333-444455556666"
    key = f"agw.{uuid}.{'A' * 43}"
    stored = spark.createDataFrame([(uuid, "t", None)], "id string, tenant_id string, revoked_at timestamp")
    stored = stored.withColumn("key_hmac", hmac_sha256(F.lit(key), b"p"))
    sent = [f"Bearer {key}", f"Bearer {key}\n", f"bearer {key}", f"Bearer agw.{uuid}.short", f"Bearer {key[:-1]}B",
            f"Bearer agw.{uuid[:-1]}7.{'A' * 43}", ""]
    rows = spark.createDataFrame(list(enumerate(sent)), "i int, authorization string")

    def outcomes(keys):
        return [r.outcome for r in identity.credential_audit(rows, keys, b"p", F.col("i")).orderBy("i").collect()]

    assert outcomes(stored) == ["ok", "malformed", "malformed", "malformed", "mismatch", "unknown", "malformed"]
    assert outcomes(stored.withColumn("revoked_at", F.lit(START)))[0] == "revoked"


def test_a_value_is_not_shuffled_unless_asked_for(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(identity, "lookup", lambda rows, *rest: joined.append(rows.columns) or salted_lookup(rows, *rest))
    keys = spark.createDataFrame([], "id string, tenant_id string, key_hmac binary, revoked_at timestamp")
    rows = spark.createDataFrame([(0, "x"), (1, None)], "i int, authorization string")
    found = identity.credential_audit(rows, keys, b"p", F.col("i")).drop("authorization")
    assert [r.outcome for r in found.orderBy("i").collect()] == ["malformed", "unknown"]
    assert joined == [["i", "authorization", "__malformed", "__mac", "__id"]]


@pytest.mark.parametrize("tenant,ok", [("a", True), ("A.b_c-1", True), (".a", False), ("", False), ("a b", False), ("é", False),
                                       ("a" * 128, True), ("a" * 129, False), ("a\n", False)])
def test_tenant_ids(spark, tenant, ok):
    assert spark.createDataFrame([(tenant,)], "t string").select(identity.valid_tenant(F.col("t"))).first()[0] is ok


def test_sliding_windows(spark):
    frame = spark.createDataFrame([(START + timedelta(minutes=m), "allow") for m in (1, 6, 11)], "event_time timestamp, decision string")
    assert sum(r.n for r in windows.windowed_decisions(frame, "10 minutes", "5 minutes").collect()) == 6
