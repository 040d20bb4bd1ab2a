"""Policy, audit-event, sink and topic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import events as ev
from auditlake.operators import policy as pol
from auditlake.operators import rules as rul
from auditlake.plans import audit
from auditlake.sources import sink, topic
from workload import data, sql
from workload.data import table
from workload.text_rules import SETS_SQL, ids, rule_sets

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


# ---- policies

def raw_policies(spark, sf):
    """One policy per customer, with blanks and bad values."""
    key = F.col("c_custkey")
    blank = F.lit("")
    return table(spark, sf, "customer").select(
        key.cast("string").alias("id"),
        F.when(key % 6 == 0, blank).when(key % 6 == 1, "tenant:").when(key % 6 == 2, "team")
        .otherwise(F.concat(F.lit("tenant:"), "c_mktsegment")).alias("scope"),
        F.when(key % 5 == 0, blank).when(key % 5 == 1, "/v1/models").otherwise("/v1/responses").alias("route_path"),
        F.when(key % 4 == 0, blank).when(key % 4 == 1, "admin").otherwise("response").alias("direction"),
        (key % 90 - 5).cast("int").alias("monitor_at"),
        (key % 120 - 3).cast("int").alias("intervention_at"),
        F.when(key % 7 == 0, blank).when(key % 7 == 1, "monitor").otherwise("redact").alias("intervention_action"),
        F.when(key % 9 == 0, blank).when(key % 9 == 1, "fail").otherwise("fail_closed").alias("auditor_failure_mode"),
        (key % 11 - 2).cast("bigint").alias("revision"),
    )


RAW_POLICIES = """raw AS (SELECT c_custkey::varchar AS id,
  CASE c_custkey % 6 WHEN 0 THEN 'global' WHEN 1 THEN 'tenant:' WHEN 2 THEN 'team' ELSE 'tenant:' || c_mktsegment END AS scope,
  CASE c_custkey % 5 WHEN 0 THEN '*' WHEN 1 THEN '/v1/models' ELSE '/v1/responses' END AS route_path,
  CASE c_custkey % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'admin' ELSE 'response' END AS direction,
  CASE WHEN c_custkey % 90 - 5 <= 0 THEN 30 ELSE c_custkey % 90 - 5 END AS monitor_at,
  CASE WHEN c_custkey % 120 - 3 <= 0 THEN 80 ELSE c_custkey % 120 - 3 END AS intervention_at,
  CASE c_custkey % 7 WHEN 0 THEN 'block' WHEN 1 THEN 'monitor' ELSE 'redact' END AS intervention_action,
  CASE c_custkey % 9 WHEN 0 THEN 'fail_open' WHEN 1 THEN 'fail' ELSE 'fail_closed' END AS auditor_failure_mode,
  CASE WHEN c_custkey % 11 - 2 <= 0 THEN 1 ELSE c_custkey % 11 - 2 END AS revision FROM customer)"""


@query("policy_defaults", f"WITH {RAW_POLICIES} SELECT * FROM raw")
def policy_defaults(spark, sf):
    return pol.policy_defaults(raw_policies(spark, sf))


@query("policy_check", f"""WITH {RAW_POLICIES} SELECT id, concat_ws(',',
  CASE WHEN scope <> 'global' AND (scope NOT LIKE 'tenant:%' OR scope = 'tenant:') THEN 'scope' END,
  CASE WHEN route_path = '/v1/models' THEN 'route_path' END,
  CASE WHEN direction = 'admin' THEN 'direction' END,
  CASE WHEN monitor_at < 1 OR intervention_at > 100 OR monitor_at >= intervention_at THEN 'thresholds' END,
  CASE WHEN intervention_action = 'monitor' THEN 'intervention_action' END,
  CASE WHEN auditor_failure_mode = 'fail' THEN 'auditor_failure_mode' END) AS errors FROM raw""")
def policy_check(spark, sf):
    return pol.policy_check(raw_policies(spark, sf)).select("id", "errors")


BOTH_WAYS = f"""traffic AS (
  SELECT doc_id::varchar AS request_id, source AS tenant_id, {sql.ROUTE} AS path, 'request' AS direction FROM documents
  UNION ALL SELECT conv_id || '-' || turn, 'c' || (conv_id % 20), '/v1/chat/completions',
    CASE WHEN role = 'assistant' THEN 'response' ELSE 'request' END FROM conversations)"""


@query("policy_resolve", f"""WITH {BOTH_WAYS}, {sql.policies()}, {sql.resolved("traffic", "request_id")}
SELECT request_id, direction, policy_id, p_revision AS revision, monitor_at, intervention_at, p_action AS action FROM resolved""")
def policy_resolve(spark, sf):
    rows = data.traffic(spark, sf).drop("capture_id").unionByName(data.conversation_traffic(spark, sf)).drop("body")
    found = pol.policy_resolve(rows, data.policies(spark))
    return found.select(
        "request_id", "direction", F.col("policy.id").alias("policy_id"), "policy.revision", "policy.monitor_at",
        "policy.intervention_at", F.col("policy.intervention_action").alias("action"),
    )


def decided(spark, sf):
    return audit.audit(data.traffic(spark, sf), data.RULES, data.policies(spark), data.RULE_VERSION)


@query("decide", sql.AUDIT + " SELECT request_id, base FROM decided")
def decide(spark, sf):
    return decided(spark, sf).select("request_id", pol.decide(F.col("risk_score"), F.col("policy")).alias("base"))


@query("elevate", sql.AUDIT + " SELECT request_id, risk_score, decision FROM decided")
def elevate(spark, sf):
    return decided(spark, sf).select("request_id", "risk_score", "decision")


@query("decision_counts", sql.AUDIT + " SELECT tenant_id, path, decision, count(*) AS n, max(risk_score) AS top_score FROM decided GROUP BY ALL")
def decision_counts(spark, sf):
    return decided(spark, sf).groupBy("tenant_id", "path", "decision").agg(
        F.count("*").alias("n"), F.max("risk_score").alias("top_score")
    )


@query("verdict_join", sql.AUDIT + ", " + sql.VERDICTED + """
SELECT request_id, first_decision, decision, auditor_verdict, auditor_error FROM promoted""")
def verdict_join(spark, sf):
    joined = pol.join_verdicts(decided(spark, sf).drop("body"), data.verdicts(spark, sf))
    return pol.verdict_decisions(joined.withColumn("first_decision", F.col("decision"))).select(
        "request_id", "first_decision", "decision", F.col("auditor.verdict").alias("auditor_verdict"), "auditor_error"
    )


@query("shadow_verdicts", sql.AUDIT + ", " + sql.VERDICTED + """
SELECT request_id, verdict AS auditor_verdict, CASE WHEN verdict IS NULL THEN 'auditor unavailable' ELSE '' END AS auditor_error
FROM joined WHERE decision = 'allow'""")
def shadow_verdicts(spark, sf):
    joined = pol.join_verdicts(decided(spark, sf).drop("body"), data.verdicts(spark, sf))
    return pol.shadow_verdicts(joined).select(
        "request_id", F.col("auditor.verdict").alias("auditor_verdict"), "auditor_error"
    )


@query("policy_coverage", f"""WITH {SETS_SQL}, {RAW_POLICIES},
c AS (SELECT (SELECT count(*) FROM sets WHERE scope = 'global' AND status = 'published' AND source = 'managed') AS managed_rule_sets,
  (SELECT count(*) FROM raw WHERE scope = 'global' AND direction = 'request') AS request_policies,
  (SELECT count(*) FROM raw WHERE scope = 'global' AND direction = 'response') AS response_policies)
SELECT *, managed_rule_sets > 0 AND request_policies > 0 AND response_policies > 0 AS covered FROM c""")
def policy_coverage(spark, sf):
    return pol.policy_coverage(rule_sets(spark, sf), pol.policy_defaults(raw_policies(spark, sf)))


@query("policy_timeline", """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision
FROM orders""")
def policy_timeline(spark, sf):
    changes = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return pol.policy_timeline(changes, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("snapshot_hash", f"""WITH {RAW_POLICIES},
h AS (SELECT sha256(concat_ws(chr(31), id, scope, route_path, direction, monitor_at, intervention_at, intervention_action,
    auditor_failure_mode, revision)) AS h FROM raw),
n AS (SELECT h, count(*) AS n FROM h GROUP BY h),
b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS d, sum(n) AS n FROM n GROUP BY 1)
SELECT sha256(string_agg(b || ':' || d, ',' ORDER BY b || ':' || d)) AS hash, sum(n)::bigint AS n_rows FROM b""")
def snapshot_hash(spark, sf):
    return pol.snapshot_hash(pol.policy_defaults(raw_policies(spark, sf)), pol.POLICY_COLUMNS)


# ---- events

def events(spark, sf, verdicts=True):
    opinions = data.verdicts(spark, sf) if verdicts else None
    return audit.audit_events(data.traffic(spark, sf), data.RULES, data.policies(spark), opinions, data.RULE_VERSION)


EVENTS_SQL = sql.AUDIT + ", " + sql.VERDICTED + f""",
twice AS (
  SELECT *, 0 AS seq FROM promoted
  UNION ALL SELECT * REPLACE (verdict AS auditor_verdict,
    CASE WHEN verdict IS NULL THEN 'auditor unavailable' ELSE '' END AS auditor_error), 1 FROM promoted WHERE first_decision = 'allow'),
event_rows AS (
  SELECT sha256(sha256('doc-' || request_id) || '|request|' || seq) AS event_id, request_id, tenant_id, path, decision, risk_score, policy_id,
    p_revision AS policy_revision, strlen(body) AS body_bytes, sha256(body) AS content_sha256, epoch_ms(ts) AS ms,
    CASE WHEN decision = 'redact' THEN NULL ELSE match_ids END AS match_ids, auditor_verdict,
    CASE WHEN auditor_verdict IS NULL THEN NULL WHEN decision = 'redact' OR auditor_verdict <> 'block' THEN '' ELSE 'label' END AS auditor_evidence,
    auditor_error, decision = 'redact' AS redacted FROM twice)"""


def flat(rows):
    return rows.select(
        "event_id", "request_id", "tenant_id", "path", "decision", "risk_score", "policy_id", "policy_revision",
        "body_bytes", "content_sha256", F.unix_millis("event_time").alias("ms"), ids().alias("match_ids"),
        F.col("auditor.verdict").alias("auditor_verdict"), F.col("auditor.evidence").alias("auditor_evidence"),
        "auditor_error", F.coalesce(F.try_element_at("metadata", F.lit("evidence_redacted")) == "true", F.lit(False)).alias("redacted"),
    )


@query("audit_events", EVENTS_SQL + " SELECT * FROM event_rows")
def audit_events(spark, sf):
    return flat(events(spark, sf))


@query("shared_request_ids", EVENTS_SQL + """ SELECT event_id, (request_id::int // 100)::varchar AS request_id, tenant_id, decision,
  auditor_verdict FROM event_rows""")
def shared_request_ids(spark, sf):
    """Callers that send the request ids of others, and their own again: no event goes, none is judged for another."""
    shared = (F.col("request_id").cast("long") / 100).cast("long").cast("string")
    opinions = data.verdicts(spark, sf).withColumn("capture_id", F.concat(F.lit("doc-"), "request_id")).withColumn("request_id", shared)
    traffic = data.traffic(spark, sf).withColumn("request_id", shared)
    rows = audit.audit_events(traffic, data.RULES, data.policies(spark), opinions, data.RULE_VERSION)
    return rows.select("event_id", "request_id", "tenant_id", "decision", F.col("auditor.verdict").alias("auditor_verdict"))


@query("redact_evidence", EVENTS_SQL + """ SELECT decision, redacted, match_ids IS NULL AS no_matches, count(*) AS n,
  count(*) FILTER (auditor_evidence <> '') AS with_evidence FROM event_rows GROUP BY ALL""")
def redact_evidence(spark, sf):
    return flat(events(spark, sf)).groupBy("decision", "redacted", F.col("match_ids").isNull().alias("no_matches")).agg(
        F.count("*").alias("n"), F.count_if(F.col("auditor_evidence") != "").alias("with_evidence")
    )


@query("event_dedup", "SELECT event_id, 0 AS copy, epoch_us(ts) // 1000 AS ms FROM events")
def event_dedup(spark, sf):
    first = table(spark, sf, "events").select("event_id", F.lit(0).alias("copy"), F.unix_millis("ts").alias("ms"))
    replay = first.filter(F.col("ms") >= 1704672000000).withColumn("copy", F.lit(1))
    return ev.event_dedup(first.unionByName(replay), ["copy"])


def day_events(spark, sf):
    """Event rows in the stored schema, made from the call log."""
    calls = data.calls(spark, sf)
    policy = F.struct(F.lit("p1").alias("id"), F.lit(1).cast("bigint").alias("revision"))
    return ev.to_events(
        calls.select(
            F.col("event_id").cast("string").alias("capture_id"), F.lit("same").alias("request_id"), F.col("event_time").alias("ts"), "tenant_id", "direction",
            "path", "decision", F.col("k").alias("risk_score"), F.lit(None).cast(rul.NO_MATCHES).alias("matches"),
            policy.alias("policy"), F.lit(0).alias("body_bytes"), F.lit("").alias("content_sha256"),
            (F.col("seconds") * 1000).cast("bigint").alias("latency_ms"),
        )
    )


@query("audit_sink", """SELECT epoch_ms(date_trunc('day', ts)) AS day_ms, count(*) AS n, count(*) AS ids,
  count(*) FILTER (json_extract(props, '$.k')::int BETWEEN 85 AND 94) AS redacted FROM events GROUP BY ALL""")
def audit_sink(spark, sf):
    """A first batch, then all events together with replays of the first ones, a day late or without time."""
    path = sink.shared_dir(spark, "events")
    rows = day_events(spark, sf)
    first = rows.filter(F.col("event_time") < "2024-01-20")
    late = first.withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 DAY"))
    timeless = first.withColumn("event_time", F.lit(None).cast("timestamp"))
    sink.audit_sink(first, path)
    sink.audit_sink(rows.unionByName(late).unionByName(timeless), path)
    stored = spark.read.parquet(path)
    marked = F.try_element_at("metadata", F.lit("evidence_redacted")) == "true"
    return stored.groupBy(F.unix_millis(F.date_trunc("day", "event_time")).alias("day_ms")).agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.count_if(marked).alias("redacted")
    )


@query("kafka_rows", EVENTS_SQL + """ SELECT tenant_id AS key, event_id AS header, decision, risk_score,
  coalesce(match_ids, '') <> '' AS has_matches, auditor_error <> '' AS has_error, auditor_verdict IS NOT NULL AS has_auditor,
  redacted AS has_metadata FROM event_rows""")
def kafka_rows(spark, sf):
    rows = topic.kafka_rows(events(spark, sf)).withColumn("v", F.try_parse_json(F.col("value").cast("string")))

    def has(name):
        return F.try_variant_get("v", f"$.{name}", "variant").isNotNull()

    return rows.select(
        F.col("key").cast("string").alias("key"), F.col("headers")[0]["value"].cast("string").alias("header"),
        F.try_variant_get("v", "$.decision", "string").alias("decision"),
        F.try_variant_get("v", "$.risk_score", "int").alias("risk_score"),
        has("matches").alias("has_matches"), has("auditor_error").alias("has_error"),
        has("auditor").alias("has_auditor"), has("metadata").alias("has_metadata"),
    )


@query("audit_topic_source", EVENTS_SQL + """ SELECT event_id, request_id, tenant_id, path, decision, risk_score, policy_id,
  policy_revision, body_bytes, content_sha256, ms, nullif(match_ids, '') AS match_ids, auditor_verdict, auditor_evidence,
  nullif(auditor_error, '') AS auditor_error, redacted FROM event_rows""".replace("policy_id,", "nullif(policy_id, '') AS policy_id,", 1))
def audit_topic_source(spark, sf):
    return flat(topic.audit_topic_source(topic.kafka_rows(events(spark, sf))))


OUTCOME_FLAGS = {
    "not_post": "k % 50 = 0", "identity_down": "k % 49 = 0", "key_invalid": "k % 23 = 0", "over_quota": "k % 19 = 0",
    "too_large": "seconds > 3", "policy_block": "decision = 'block'", "auditor_down": "k % 13 = 0",
    "auditor_block": "k % 11 = 0", "response_block": "k % 7 = 0", "stream_block": "k % 5 = 0",
}
CALLS_SQL = """calls AS (SELECT *, CASE WHEN k < 70 THEN 'allow' WHEN k < 85 THEN 'monitor' WHEN k < 95 THEN 'redact' ELSE 'block' END AS decision,
  CASE WHEN k < 80 THEN 200 WHEN k < 90 THEN 403 ELSE 429 END AS status, value / 100 AS seconds, 'u' || user_id AS tenant_id,
  CASE event_type WHEN 'click' THEN '/v1/chat/completions' WHEN 'view' THEN '/v1/completions' WHEN 'purchase' THEN '/v1/embeddings'
    WHEN 'signup' THEN '/v1/responses' ELSE '/v1/errors' END AS path,
  CASE WHEN event_id % 3 = 0 THEN 'response' ELSE 'request' END AS direction
  FROM (SELECT *, json_extract(props, '$.k')::int AS k FROM events))"""


def _outcome_sql() -> str:
    cases = " ".join(f"WHEN {OUTCOME_FLAGS[f]} THEN '{s}|{c}'" for f, s, c in ev.OUTCOMES)
    early = " OR ".join(OUTCOME_FLAGS[f] for f, _, _ in ev.OUTCOMES[:5])
    return f"""WITH {CALLS_SQL}, o AS (SELECT event_id, CASE {cases} ELSE '200|proxied' END AS o, NOT ({early}) AS emits_event FROM calls)
SELECT event_id, split_part(o, '|', 1)::int AS status, split_part(o, '|', 2) AS code, emits_event FROM o"""


@query("request_outcome", _outcome_sql())
def request_outcome(spark, sf):
    flags = data.calls(spark, sf).withColumns({name: F.expr(test) for name, test in OUTCOME_FLAGS.items()})
    return ev.request_outcome(flags).select("event_id", "status", "code", "emits_event")


@query("admin_events", """WITH ops AS (SELECT o_orderkey::varchar AS request_id, CASE o_orderstatus WHEN 'P' THEN 'rule_set_publish' WHEN 'F' THEN 'policy_delete' ELSE 'api_key_revoke' END AS operation,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'tenant:' || o_orderpriority END AS scope, sha256('token-' || (o_custkey % 50)) AS actor_hash FROM orders)
SELECT sha256(sha256(request_id) || '|admin|0') AS event_id, operation, scope, actor_hash, 'success' AS decision, 'admin' AS tenant_id FROM ops""")
def admin_events(spark, sf):
    status = F.col("o_orderstatus")
    ops = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("capture_id"),
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderdate").alias("ts"), F.lit("/admin/v1").alias("path"),
        F.when(status == "P", "rule_set_publish").when(status == "F", "policy_delete").otherwise("api_key_revoke").alias("operation"),
        F.when(status == "F", "").otherwise(F.concat(F.lit("tenant:"), "o_orderpriority")).alias("scope"),
        F.lit("success").alias("outcome"), F.col("o_orderkey").cast("string").alias("version"),
        F.concat(F.lit("Bearer token-"), F.col("o_custkey") % 50).alias("authorization"),
    )
    rows = ev.admin_events(ops)
    return rows.select(
        "event_id", *[F.col("metadata")[k].alias(k) for k in ("operation", "scope", "actor_hash")], "decision", "tenant_id"
    )


@query("latest_events", f"""WITH {CALLS_SQL}, g AS (SELECT 'all' AS kind, tenant_id, event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM calls),
p AS (SELECT 'tenant' AS kind, tenant_id, event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) AS rank FROM calls)
SELECT kind, tenant_id, event_id FROM g WHERE rank <= 50 UNION ALL SELECT kind, tenant_id, event_id FROM p WHERE rank <= 3""")
def latest_events(spark, sf):
    calls = data.calls(spark, sf).select("tenant_id", "event_id", "event_time")
    newest = ev.latest_events(calls, 50).select(F.lit("all").alias("kind"), "tenant_id", "event_id")
    each = ev.latest_events(calls, 3, "tenant_id").select(F.lit("tenant").alias("kind"), "tenant_id", "event_id")
    return newest.unionByName(each)


PAGES = """traffic AS (SELECT page_id::varchar AS request_id, 'src' || (page_id % 5) AS tenant_id, 'response' AS direction,
  '/v1/completions' AS path, html AS body FROM pages)"""
PAGE_CAP = 4096


@query("response_audit", "WITH " + sql.audited(PAGES, text=sql.normal("body"))
       + f""" SELECT request_id, decision, strlen(body) > {PAGE_CAP} AS too_large, risk_score, policy_id FROM decided""")
def response_audit(spark, sf):
    rows = audit.audit_responses(data.page_traffic(spark, sf), data.RULES, data.policies(spark), PAGE_CAP)
    return rows.select("request_id", "decision", "too_large", "risk_score", F.col("policy.id").alias("policy_id"))
