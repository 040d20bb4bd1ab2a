import itertools
import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import events as ev
from auditlake.operators import policy as pol
from auditlake.operators.rules import Rule
from auditlake.plans import audit, lookup
from auditlake.schemas import POLICY_FIELDS
from auditlake.sources import config, sink, topic

CHAT, RESPONSES = "/v1/chat/completions", "/v1/responses"


def policies(spark, rows):
    return spark.createDataFrame([(i, s, p, d, 30, 80, a, m, 1) for i, s, p, d, a, m in rows], POLICY_FIELDS)


def best_policy(table, tenant, path, direction):
    """Of the policies for a direction: the tenant's before everybody's, then the route's before any route's."""
    fits = [p for p in table if p[1] in ("global", f"tenant:{tenant}") and p[2] in ("*", path) and p[3] == direction]
    return min(fits, key=lambda p: (p[1] == "global", p[2] == "*"), default=[""])[0]


@pytest.mark.parametrize("limit", [lookup.MAX_BROADCAST_BYTES, 0])
def test_precedence(spark, limit, monkeypatch):
    monkeypatch.setattr(lookup.lookup, "__defaults__", ("left", limit))
    scopes, routes, directions = ["global", "tenant:x", "tenant:y"], ["*", "/v1/completions", RESPONSES], ["request", "response"]
    every = [(f"p{i}", s, r, d, "block", "") for i, (s, r, d) in enumerate(itertools.product(scopes, routes, directions))]
    rng = random.Random(3)
    calls = [(str(i), t, p, d) for i, (t, p, d) in enumerate(itertools.product("xyz", ["/v1/completions", RESPONSES, "/v1/embeddings"], directions))]
    asked = spark.createDataFrame(calls, "request_id string, tenant_id string, path string, direction string")
    for size in (0, 5, 9, len(every)):
        table = rng.sample(every, size)
        found = {r.request_id: r.policy for r in pol.policy_resolve(asked, policies(spark, table)).collect()}
        assert {k: p.id for k, p in found.items()} == {i: best_policy(table, t, p, d) for i, t, p, d in calls}
        assert {p.revision for p in found.values()} == {1}


def test_thresholds(spark):
    rows = spark.createDataFrame([(29,), (30,), (80,)], "s int").select("s", pol._fallback().alias("p"))
    assert [r.d for r in rows.select(pol.decide(F.col("s"), F.col("p")).alias("d")).collect()] == ["allow", "monitor", "block"]


@pytest.mark.parametrize("base,actions,want", [
    ("allow", ["monitor"], "monitor"), ("block", ["redact"], "block"), ("monitor", ["redact", "monitor"], "redact"),
    ("allow", ["odd"], "allow"), ("redact", ["block"], "block"), ("allow", [], "allow"),
])
def test_elevate(spark, base, actions, want):
    rows = spark.createDataFrame([(base, [(a,) for a in actions])], "d string, m array<struct<action:string>>")
    assert rows.select(pol.elevate(F.col("d"), F.col("m")).alias("r")).first().r == want


def traffic(spark, rows):
    return spark.createDataFrame(
        [(r, t, "", d, "", p, b.encode(), None) for r, t, d, p, b in rows],
        "request_id string, tenant_id string, api_key_id string, direction string, model string, path string, body binary, ts timestamp",
    )


VERDICT = "request_id string, verdict string, risk_score int, confidence double, categories array<string>, evidence string, model string, version string, error string"


def test_verdicts(spark):
    rows = traffic(spark, [(i, "t" if i != "closed" else "c", "request", CHAT, "watch") for i in ("bad", "good", "high", "lost", "closed")])
    rules = [Rule("w", "", "watch", action="monitor", weight=40)]
    table = policies(spark, [("o", "global", "*", "request", "redact", "fail_open"), ("c", "tenant:c", "*", "request", "block", "fail_closed")])
    opinions = spark.createDataFrame([
        ("bad", "block", 0, 0.9, ["x"], "quote", "m", "1", ""), ("good", "allow", 10, 0.9, [], "", "m", "1", ""),
        ("high", "allow", 80, 0.9, [], "", "m", "1", ""), ("lost", "allow", 0, 0.0, [], "", "m", "1", "timeout"),
        ("closed", None, None, None, None, None, None, None, "timeout"),
    ], VERDICT)
    found = {r.request_id: r for r in audit.audit_events(rows, rules, table, opinions).collect()}
    assert {k: r.decision for k, r in found.items()} == {"bad": "block", "good": "monitor", "high": "block", "lost": "monitor", "closed": "block"}
    assert found["closed"].auditor is None and found["closed"].auditor_error == "timeout"
    assert found["bad"].auditor.evidence == "quote" and found["lost"].auditor_error == "timeout"


def test_redaction_leaks_nothing(spark):
    rows = traffic(spark, [("1", "t", "request", CHAT, "blueprint"), ("2", "t", "request", CHAT, "clean")])
    rules = [Rule("n", "secret name", "blueprint", action="redact", weight=40)]
    events = audit.audit_events(rows, rules, policies(spark, [])).orderBy("request_id")
    first, second = events.collect()
    assert first.decision == "redact" and first.matches is None and first.metadata == {"evidence_redacted": "true"}
    assert first.risk_score == 40 and first.body_bytes == 9 and len(first.content_sha256) == 64
    assert second.decision == "allow" and second.metadata is None
    assert b"blueprint" not in bytes(topic.kafka_rows(events).collect()[0].value)


def test_events_are_reproducible(spark):
    rows = traffic(spark, [("1", "t", "request", CHAT, "a")])
    ids = {audit.audit_events(rows, [], policies(spark, [])).first().event_id for _ in range(2)}
    assert len(ids) == 1


def test_one_request_id_of_several_callers(spark):
    """Two tenants, and one of them twice, send the same request id: three captures, judged and stored apart."""
    rows = traffic(spark, [("1", "a", "request", CHAT, "fine"), ("1", "b", "request", CHAT, "blueprint"), ("1", "a", "request", CHAT, "other")])
    rules = [Rule("n", "", "blueprint", action="monitor", weight=40)]
    opinion = (0, 0.9, [], "", "m", "1", "")
    opinions = spark.createDataFrame([("a", "1", "allow", *opinion), ("b", "1", "block", *opinion), ("b", "1", "block", *opinion)], "tenant_id string, " + VERDICT)
    found = audit.audit_events(rows, rules, policies(spark, []), opinions).collect()
    assert sorted((e.tenant_id, e.decision, e.auditor.verdict) for e in found if e.decision != "allow" or e.auditor) == [
        ("a", "allow", "allow"), ("a", "allow", "allow"), ("b", "block", "block")]
    assert len(found) == len({e.event_id for e in found}) == 5


def test_sink_is_idempotent(spark, tmp_path):
    rows = traffic(spark, [("1", "t", "request", CHAT, "a"), ("1", "t", "request", CHAT, "a"), ("2", "t", "request", CHAT, "b")])
    events = audit.audit_events(rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), [], policies(spark, []))
    path = str(tmp_path / "events")
    assert sink.read_events(spark, path) is None
    sink.audit_sink(events, path)
    for time in ("2024-01-01", "2024-03-01", None):
        sink.audit_sink(events.withColumn("event_time", F.lit(time).cast("timestamp")), path)
    sink.audit_sink(events.limit(1).withColumns({"event_id": F.lit("new"), "event_time": F.lit(None).cast("timestamp")}), path)
    sink.audit_sink(events.limit(1).withColumns({"event_id": F.lit("new"), "event_time": F.lit(None).cast("timestamp")}), path)
    assert sink.read_events(spark, path).count() == 3


def test_stream_to_sink(spark, tmp_path):
    rows = traffic(spark, [(str(i), "t", "request", CHAT, "a") for i in range(5)]).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    for part in ("one", "two"):
        audit.audit_events(rows, [], policies(spark, [])).write.parquet(str(tmp_path / "in" / part))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "one")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    sink.stream_to_sink(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sink.read_events(spark, str(tmp_path / "out")).count() == 5


def test_outcome_precedence(spark):
    names = [name for name, _, _ in ev.OUTCOMES]
    rows = spark.createDataFrame([tuple(j >= i for j in range(len(names))) for i in range(len(names) + 1)], ", ".join(f"{n} boolean" for n in names))
    found = [r.code for r in ev.request_outcome(rows).collect()]
    assert found == [code for _, _, code in ev.OUTCOMES] + ["proxied"]
    relaxed = ev.request_outcome(rows, audit_enabled=False).collect()
    assert relaxed[5].code == "proxied" and relaxed[5].emits_event


def test_whole_response(spark):
    rows = traffic(spark, [("1", "t", "response", CHAT, "the blueprint"), ("2", "t", "response", CHAT, "x" * 50 + " blueprint"), ("3", "t", "response", CHAT, "ok")])
    rules = [Rule("r", "", "blueprint", action="block", weight=85)]
    found = audit.audit_responses(rows, rules, policies(spark, []), 20).orderBy("request_id").collect()
    assert [(r.decision, r.too_large) for r in found] == [("block", False), ("block", True), ("allow", False)]
    events = audit.response_events(rows, rules, policies(spark, []), max_bytes=20).orderBy("request_id").collect()
    assert [(e.decision, e.metadata) for e in events] == [("block", None), ("block", {"too_large": "true"}), ("allow", None)]
    opinions = spark.createDataFrame([("3", "allow", 0, 0.9, [], "", "m", "1", "")], VERDICT)
    shadowed = audit.response_events(rows, rules, policies(spark, []), opinions).collect()
    assert sorted((e.request_id, e.auditor is not None) for e in shadowed) == [("1", False), ("2", False), ("3", False), ("3", True)]


def test_plain_sessions_are_refused(spark):
    plain = spark.newSession()
    plain.conf.unset("spark.sql.variant.allowDuplicateKeys")
    with pytest.raises(ValueError, match="configure"):
        audit.audit_events(traffic(plain, [("1", "t", "request", CHAT, "a")]), [], policies(plain, []))


def test_config_file(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text('{"rules":[{"id":"c","pattern":"sk-[a-z0-9]+","weight":85,"regex":true}],\n"policies":[{"scope":"global"},{"scope":"global","direction":"response"}]}')
    loaded = config.load_config(spark, str(path))
    assert [(r.position, r.id, r.weight) for r in config.config_rules(loaded).collect()] == [(0, "c", 85)]
    assert config.config_policies(loaded).count() == 2
