"""Counter, alert, quota, window and key queries over events, customers and orders."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from auditlake.operators import identity, quota, windows
from auditlake.operators import metrics as met
from auditlake.operators import rules as rul
from workload import data, sql
from workload.data import table
from workload.policy_events import CALLS_SQL
from workload.text_rules import matched

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(function):
        def run(spark, sf_dir):
            return function(data.configure(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return register


ENDPOINT = "CASE WHEN path = '/v1/errors' THEN '/v1/other' ELSE path END"


def served(spark, sf):
    from auditlake.functions.text import endpoint_bucket

    return data.calls(spark, sf).withColumn("endpoint", endpoint_bucket(F.col("path")))


@query("counters", f"""WITH {CALLS_SQL}
SELECT 'requests' AS counter, {ENDPOINT} AS a, status::varchar AS b, count(*) AS n FROM calls GROUP BY ALL
UNION ALL SELECT 'decisions', decision, direction, count(*) FROM calls GROUP BY ALL
UNION ALL SELECT 'rejections', {ENDPOINT}, '', count(*) FROM calls WHERE status = 429 GROUP BY ALL""")
def counters(spark, sf):
    rows = served(spark, sf)
    requests = met.counters(rows, "endpoint", "status").select(
        F.lit("requests").alias("counter"), F.col("endpoint").alias("a"), F.col("status").cast("string").alias("b"), "n")
    decisions = met.counters(rows, "decision", "direction").select(
        F.lit("decisions").alias("counter"), F.col("decision").alias("a"), F.col("direction").alias("b"), "n")
    refused = met.counters(rows.filter("status = 429"), "endpoint").select(
        F.lit("rejections").alias("counter"), F.col("endpoint").alias("a"), F.lit("").alias("b"), "n")
    return requests.unionByName(decisions).unionByName(refused)


_LE = ", ".join(f"({b})" for b in met.LATENCY_BUCKETS)
HISTOGRAM_SQL = f"""served AS (SELECT *, {ENDPOINT} AS endpoint FROM calls),
bounds(le, bound) AS (VALUES {", ".join(f"('{b}', {b}::double)" for b in met.LATENCY_BUCKETS)}, ('+Inf', 'inf'::double)),
totals AS (SELECT endpoint, sum(seconds) AS sum, count(*) AS count FROM served GROUP BY 1),
histogram AS (SELECT s.endpoint, b.le, count(*) FILTER (s.seconds <= b.bound) AS bucket_count FROM served s CROSS JOIN bounds b GROUP BY ALL)"""


@query("latency_histogram", f"""WITH {CALLS_SQL}, {HISTOGRAM_SQL}
SELECT endpoint, le, bucket_count, round(sum, 4) AS sum, count FROM histogram JOIN totals USING (endpoint)""")
def latency_histogram(spark, sf):
    rows = met.latency_histogram(served(spark, sf), "seconds", "endpoint")
    return rows.withColumn("sum", F.round("sum", 4))


@query("metric_samples", f"""WITH {CALLS_SQL}, {HISTOGRAM_SQL}
SELECT 'audit_http_requests_total' AS name, 'endpoint=' || endpoint || ',status=' || status AS labels, count(*)::double AS value FROM served GROUP BY ALL
UNION ALL SELECT 'audit_ready', '', (count(*) FILTER (k >= 50) > 0)::int::double FROM served
UNION ALL SELECT 'audit_http_duration_seconds_bucket', 'endpoint=' || endpoint || ',le=' || le, bucket_count::double FROM histogram
UNION ALL SELECT 'audit_http_duration_seconds_sum', 'endpoint=' || endpoint, round(sum, 4) FROM totals
UNION ALL SELECT 'audit_http_duration_seconds_count', 'endpoint=' || endpoint, count::double FROM totals""")
def metric_samples(spark, sf):
    rows = served(spark, sf)
    table_ = met.metric_samples(
        met.counter_samples("audit_http_requests_total", met.counters(rows, "endpoint", "status"), "endpoint", "status"),
        met.gauge_samples("audit_ready", rows.agg((F.count_if(F.col("k") >= 50) > 0).cast("int").alias("v")), "v"),
        met.histogram_samples("audit_http_duration_seconds", met.latency_histogram(rows, "seconds", "endpoint"), "endpoint"),
    )
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table_.select("name", F.array_join(pairs, ",").alias("labels"), F.round("value", 4).alias("value"))


@query("dashboard", f"""WITH {CALLS_SQL} SELECT count(*) AS requests, count(*) FILTER (decision = 'block') AS blocked,
  round(quantile_cont(seconds, 0.95), 6) AS p95 FROM calls""")
def dashboard(spark, sf):
    return met.dashboard(data.calls(spark, sf), "decision", "seconds").withColumn("p95", F.round("p95", 6))


@query("decision_rollup", f"""WITH {CALLS_SQL} SELECT tenant_id, path, direction, decision, count(*) AS n,
  GROUPING(tenant_id, path, direction, decision)::int AS level FROM calls GROUP BY ROLLUP (tenant_id, path, direction, decision)""")
def decision_rollup(spark, sf):
    return met.decision_rollup(data.calls(spark, sf), "tenant_id", "path", "direction")


@query("top_rules", sql.AUDIT + """ SELECT h.id AS rule_id, count(*) AS hits, count(DISTINCT t.tenant_id) AS tenants
FROM hits h JOIN traffic t USING (request_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def top_rules(spark, sf):
    return met.top_rules(rul.rule_hits(matched(spark, sf), "tenant_id"), 3)


HOLD = 1800


@query("alert_for", f"""WITH {CALLS_SQL}, m AS (SELECT event_type AS series, ts, event_id, k >= 20 AS firing,
  sum(CASE WHEN k >= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS island FROM calls),
i AS (SELECT series, island, min(ts) AS a, max(ts) AS b, count(*) AS samples FROM m WHERE firing GROUP BY ALL)
SELECT series, epoch_us(a) AS started_us, epoch_us(b) AS ended_us, samples FROM i WHERE epoch_us(b) - epoch_us(a) >= {HOLD} * 1000000""")
def alert_for(spark, sf):
    samples = data.calls(spark, sf).select(
        F.col("event_type").alias("series"), F.col("event_time").alias("ts"), F.col("event_id").alias("seq"),
        (F.col("k") >= 20).alias("firing"),
    )
    fired = met.alert_for(samples, F.lit(HOLD))
    return fired.select("series", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "samples")


@query("readiness_rollup", f"""WITH {CALLS_SQL}, l AS (SELECT event_type <> 'view' AS required, k, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM calls)
SELECT CASE WHEN count(*) FILTER (required AND k >= 60) > 0 THEN 'not_ready' ELSE 'ready' END AS status, count(*) AS components,
  count(*) FILTER (required AND k >= 60) AS failing FROM l WHERE rn = 1""")
def readiness_rollup(spark, sf):
    probes = data.calls(spark, sf).select(
        F.col("event_type").alias("component"), (F.col("event_type") != "view").alias("required"),
        F.when(F.col("k") < 60, "ok").otherwise("error").alias("status"), F.col("event_time").alias("checked_at"),
        F.col("event_id").alias("seq"),
    )
    return met.readiness_rollup(probes)


NOW = "2024-01-20 00:00:00"


@query("outbox_backlog", f"""WITH {CALLS_SQL}, o AS (SELECT event_id, ts, k, ts + to_minutes(k) AS available_at,
    CASE WHEN k % 5 = 0 THEN ts + INTERVAL 40 DAY END AS lease_until FROM calls WHERE k >= 60)
SELECT event_id, (SELECT count(*) FROM o) AS pending FROM o WHERE available_at <= TIMESTAMP '{NOW}'
  AND (lease_until IS NULL OR lease_until < TIMESTAMP '{NOW}') ORDER BY ts, event_id LIMIT 100""")
def outbox_backlog(spark, sf):
    k = F.col("k")
    outbox = data.calls(spark, sf).select(
        "event_id", F.col("event_time").alias("created_at"),
        (F.col("event_time") + F.make_dt_interval(mins=k)).alias("available_at"),
        F.when(k % 5 == 0, F.col("event_time") + F.make_dt_interval(days=F.lit(40))).alias("lease_until"),
        F.when(k < 60, F.col("event_time")).alias("published_at"),
    )
    claimable = met.outbox_claimable(outbox, F.lit(NOW).cast("timestamp"))
    return claimable.select("event_id").withColumn("pending", met.outbox_pending(outbox).scalar())


@query("auditor_outages", f"""WITH {CALLS_SQL}, r AS (SELECT 'a' || (user_id % 3) AS auditor, ts, event_id, k >= 40 AS failed FROM calls WHERE k < 97),
g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY auditor ORDER BY ts, event_id) AS run FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY auditor, run ORDER BY ts, event_id) AS pos FROM g WHERE failed)
SELECT auditor, epoch_us(ts) AS opened_us, epoch_us(ts) + 30000000 AS until_us, (pos // 5)::int AS nth_in_run FROM p WHERE pos % 5 = 0""")
def auditor_outages(spark, sf):
    k = F.col("k")
    log = data.calls(spark, sf).select(
        F.concat(F.lit("a"), F.col("user_id") % 3).alias("auditor"), F.col("event_time").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(k >= 97, met.CIRCUIT_OPEN).when(k >= 40, "timeout").otherwise("").alias("error"),
    )
    found = met.auditor_outages(log)
    return found.select("auditor", F.unix_micros("opened_at").alias("opened_us"),
                        F.unix_micros("open_until").alias("until_us"), "nth_in_run")


# ---- quotas: 3 calls at once, one more per hour

RATE, BURST, PERIOD = 1, 3, 3_600_000
LIMIT_SQL = f"""WITH RECURSIVE {CALLS_SQL},
r AS (SELECT event_id, tenant_id || ':' || path AS key, path, epoch_us(ts) // 1000 AS ms,
  row_number() OVER (PARTITION BY tenant_id || ':' || path ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM calls),
s AS (
  SELECT event_id, key, path, ms, rn, ({BURST * PERIOD} - {PERIOD})::bigint AS level, true AS allowed FROM r WHERE rn = 1
  UNION ALL
  SELECT r.event_id, r.key, r.path, r.ms, r.rn,
    (least({BURST * PERIOD}, s.level + (r.ms - s.ms) * {RATE}) - CASE WHEN least({BURST * PERIOD}, s.level + (r.ms - s.ms) * {RATE}) >= {PERIOD} THEN {PERIOD} ELSE 0 END)::bigint,
    least({BURST * PERIOD}, s.level + (r.ms - s.ms) * {RATE}) >= {PERIOD}
  FROM s JOIN r ON r.key = s.key AND r.rn = s.rn + 1),
limited AS (SELECT event_id, path, allowed, ceil(greatest(0, {PERIOD} - level) / {RATE})::bigint AS retry_ms FROM s)"""


def limited(spark, sf):
    requests = data.calls(spark, sf).select("event_id", "tenant_id", "path", F.col("event_time").alias("ts"))
    return quota.rate_limit(requests, "event_id", RATE, BURST, PERIOD)


@query("rate_limit", LIMIT_SQL + " SELECT event_id, allowed, retry_ms FROM limited")
def rate_limit(spark, sf):
    return limited(spark, sf).select("event_id", "allowed", "retry_ms")


@query("quota_report", LIMIT_SQL + f""" SELECT {ENDPOINT} AS endpoint, count(*) AS requests, count(*) FILTER (NOT allowed) AS rejected,
  max(greatest(1, retry_ms // 1000)) FILTER (NOT allowed) AS max_wait_s FROM limited GROUP BY 1""")
def quota_report(spark, sf):
    return quota.quota_report(limited(spark, sf))


# ---- time windows

@query("windowed_decisions", f"""WITH {CALLS_SQL},
t AS (SELECT 'day' AS kind, time_bucket(INTERVAL 1 DAY, ts) AS w, decision FROM calls
  UNION ALL SELECT 'slide', time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i), decision FROM calls, range(2) r(i))
SELECT kind, epoch_ms(w) AS start_ms, decision, count(*) AS n FROM t GROUP BY ALL""")
def windowed_decisions(spark, sf):
    rows = data.calls(spark, sf)
    day = windows.windowed_decisions(rows, "1 day").withColumn("kind", F.lit("day"))
    slide = windows.windowed_decisions(rows, "12 hours", "6 hours").withColumn("kind", F.lit("slide"))
    return day.unionByName(slide).select("kind", F.unix_millis("window_start").alias("start_ms"), "decision", "n")


@query("tenant_sessions", f"""WITH {CALLS_SQL}, g AS (SELECT tenant_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM calls WINDOW w AS (PARTITION BY tenant_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id ORDER BY ts) AS session FROM g)
SELECT tenant_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY tenant_id, session""")
def tenant_sessions(spark, sf):
    rows = windows.tenant_sessions(data.calls(spark, sf), "2 hours")
    return rows.select("tenant_id", F.unix_micros("session_start").alias("start_us"),
                       F.unix_micros("session_end").alias("end_us"), "n")


# ---- keys

PEPPER = b"pepper-for-tests-only"


def _uuid(digest):
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _credential(key, name):
    secret = F.substring(F.sha2(name, 256), 1, 43)
    return F.concat_ws(".", F.lit("agw"), _uuid(F.md5(key.cast("string"))), secret)


def api_keys(spark, sf):
    from auditlake.functions.digest import hmac_sha256

    customers = table(spark, sf, "customer")
    key = F.col("c_custkey")
    whole = _credential(key, F.col("c_name"))
    return customers.select(
        _uuid(F.md5(key.cast("string"))).alias("id"), F.col("c_mktsegment").alias("tenant_id"),
        F.substring(whole, 1, 12).alias("prefix"),
        # Some stored digests belong to another pepper.
        F.when(key % 17 == 0, hmac_sha256(whole, b"old")).otherwise(hmac_sha256(whole, PEPPER)).alias("key_hmac"),
        F.timestamp_seconds(F.lit(788918400) + key * 60).alias("created_at"),
        F.when(F.col("c_acctbal") < 0, F.timestamp_seconds(F.lit(883612800) + key * 3600)).alias("revoked_at"),
        key.alias("c_custkey"),
    )


def _pad(secret: bytes, mask: int) -> str:
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    return bytes(b ^ mask for b in secret.ljust(64, b"\0")).hex()


def _hmac_sql(message: str, secret: bytes) -> str:
    return (f"sha256(unhex('{_pad(secret, 0x5C)}') || unhex(sha256(unhex('{_pad(secret, 0x36)}') || encode({message}))))")


def _uuid_sql(digest: str) -> str:
    return " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


KEYS_SQL = f"""whole_keys AS (SELECT *, {_uuid_sql("md5(c_custkey::varchar)")} AS id,
    'agw.' || {_uuid_sql("md5(c_custkey::varchar)")} || '.' || substr(sha256(c_name), 1, 43) AS whole FROM customer),
api_keys AS (SELECT id, c_custkey, c_mktsegment AS tenant_id, substr(whole, 1, 12) AS prefix, whole,
    CASE WHEN c_custkey % 17 = 0 THEN {_hmac_sql("whole", b"old")} ELSE {_hmac_sql("whole", PEPPER)} END AS key_hmac,
    make_timestamp((788918400 + c_custkey * 60) * 1000000) AS created_at,
    CASE WHEN c_acctbal < 0 THEN make_timestamp((883612800 + c_custkey * 3600) * 1000000) END AS revoked_at FROM whole_keys)"""


def presented(spark, sf):
    """Credentials sent with each order: some cut short, some of customers that do not exist."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = table(spark, sf, "orders").join(customers, "o_custkey", "left")
    key = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey"))
    whole = _credential(key, F.coalesce("c_name", F.lit("nobody")))
    scheme = F.when(F.col("o_orderkey") % 11 == 0, "Basic ").otherwise("Bearer ")
    sent = F.concat(scheme, F.when(F.col("o_orderkey") % 7 == 0, F.substring(whole, 1, 50)).otherwise(whole))
    return orders.select("o_orderkey", "o_orderdate", "o_custkey", sent.alias("authorization"))


CREDENTIAL_SQL = f"""WITH {KEYS_SQL},
sent AS (SELECT o.o_orderkey, o.o_orderdate, o.o_orderkey % 11 = 0 OR o.o_orderkey % 7 = 0 AS malformed, o.o_orderkey % 13 = 0 AS unknown, k.*
  FROM orders o LEFT JOIN api_keys k ON k.c_custkey = o.o_custkey),
c AS (SELECT o_orderkey, id, tenant_id, CASE WHEN malformed THEN 'malformed' WHEN unknown OR id IS NULL THEN 'unknown' WHEN {{revoked}} THEN 'revoked'
  WHEN key_hmac <> {_hmac_sql("whole", PEPPER)} THEN 'mismatch' ELSE 'ok' END AS outcome FROM sent)
SELECT o_orderkey, outcome, CASE WHEN outcome = 'ok' THEN id END AS api_key_id, CASE WHEN outcome = 'ok' THEN tenant_id END AS key_tenant_id FROM c"""


@query("credential_audit", CREDENTIAL_SQL.format(revoked="revoked_at IS NOT NULL"))
def credential_audit(spark, sf):
    return identity.credential_audit(
        presented(spark, sf), api_keys(spark, sf).drop("c_custkey"), PEPPER, F.col("o_orderkey")
    ).drop("authorization", "o_orderdate", "o_custkey")


@query("credential_audit_asof", CREDENTIAL_SQL.format(revoked="revoked_at <= o_orderdate"))
def credential_audit_asof(spark, sf):
    return identity.credential_audit(
        presented(spark, sf), api_keys(spark, sf).drop("c_custkey"), PEPPER, F.col("o_orderkey"), F.col("o_orderdate")
    ).drop("authorization", "o_orderdate", "o_custkey")


@query("key_inventory", f"WITH {KEYS_SQL} SELECT id, tenant_id, prefix, epoch_ms(created_at) AS created_ms, epoch_ms(revoked_at) AS revoked_ms FROM api_keys")
def key_inventory(spark, sf):
    return identity.key_inventory(api_keys(spark, sf)).select(
        "id", "tenant_id", "prefix", F.unix_millis("created_at").alias("created_ms"), F.unix_millis("revoked_at").alias("revoked_ms")
    )


@query("key_revocations", "SELECT o_custkey::varchar AS id, epoch_ms(min(o_orderdate)) AS revoked_ms, count(*) AS attempts FROM orders GROUP BY 1")
def key_revocations(spark, sf):
    log = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderdate").alias("revoked_at")
    )
    return identity.key_revocations(log).select("id", F.unix_millis("revoked_at").alias("revoked_ms"), "attempts")


@query("key_usage", f"""WITH {KEYS_SQL}, u AS (SELECT k.id, k.tenant_id, k.revoked_at, count(o.o_orderkey) AS calls,
    count(*) FILTER (o.o_orderdate >= k.revoked_at) AS late_calls FROM api_keys k LEFT JOIN orders o ON o.o_custkey = k.c_custkey GROUP BY ALL)
SELECT id, tenant_id, calls, late_calls, CASE WHEN calls = 0 THEN 'unused' WHEN late_calls > 0 THEN 'used_after_revocation'
  WHEN revoked_at IS NOT NULL THEN 'revoked' ELSE 'active' END AS state FROM u""")
def key_usage(spark, sf):
    used = table(spark, sf, "orders").select(
        _uuid(F.md5(F.col("o_custkey").cast("string"))).alias("api_key_id"), F.col("o_orderdate").alias("event_time"),
        F.col("o_orderkey").alias("event_id"),
    )
    return identity.key_usage(api_keys(spark, sf), used)


@query("tenant_check", """SELECT t AS tenant_id, count(*) AS n FROM (
  SELECT CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN '-' || p_brand WHEN p_size % 4 = 2 THEN p_type || '.' || p_size ELSE p_brand END AS t FROM part)
WHERE NOT regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') GROUP BY 1""")
def tenant_check(spark, sf):
    kind = F.col("p_size") % 4
    tenant = (
        F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat(F.lit("-"), "p_brand"))
        .when(kind == 2, F.concat_ws(".", "p_type", "p_size")).otherwise(F.col("p_brand"))
    )
    return identity.tenant_check(table(spark, sf, "part").select(tenant.alias("tenant_id")))
