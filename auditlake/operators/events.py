"""Audit events: assembly, redaction, dedup, outcomes, operation log, newest-first reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions.text import body_bytes, content_sha256
from auditlake.operators.rules import NO_MATCHES
from auditlake.schemas import EVENT_COLUMNS, VERDICT

MAX_RESPONSE_BYTES = 16 << 20


#: What tells captured rows apart besides their content.
CAPTURED = ["tenant_id", "api_key_id", "direction", "path", "request_id", "ts", "seq", "frag", "channel", "metadata"]


def with_capture_id(rows: DataFrame) -> DataFrame:
    """Adds ``capture_id``, the identity of a captured row, where the capture gave none.

    Callers choose request_id, so two of them may send the same one. The id is a digest of tenant,
    key, path, time and content; rows equal in all of these are one capture.
    """
    if "capture_id" in rows.columns:
        return rows
    content = "content_sha256" if "content_sha256" in rows.columns else "body"
    parts = [F.col(c) for c in CAPTURED if c in rows.columns]
    parts += [content_sha256(F.col("body")).alias("content_sha256") if content == "body" else F.col(content)] if content in rows.columns else []
    return rows.withColumn("capture_id", F.sha2(F.to_json(F.struct(*parts)), 256))


def event_id(capture: Column, direction: Column, sequence: Column) -> Column:
    """Deterministic id, so that a rerun writes the same events again; the first part has a fixed length."""
    return F.sha2(F.concat_ws("|", F.sha2(capture, 256), F.coalesce(direction, F.lit("")), sequence), 256)


def to_events(audited: DataFrame, sequence: Column | None = None) -> DataFrame:
    """Audited rows -> event rows (schema version 2), before redaction.

    The event id is made from capture_id, see ``with_capture_id``. Needs request_id, tenant_id, direction, path, body, decision, risk_score, matches,
    policy; other event columns are taken where present.
    """
    sequence = F.lit(0) if sequence is None else sequence
    audited = with_capture_id(audited)
    have = set(audited.columns)

    def given(name: str, otherwise) -> Column:
        return F.col(name) if name in have else otherwise

    values = {
        "schema_version": F.lit("2"),
        "event_id": event_id(F.col("capture_id"), F.col("direction"), sequence.cast("string")),
        "event_time": given("ts", F.lit(None).cast("timestamp")),
        "model": given("model", F.lit("")),
        "rule_version": given("rule_version", F.lit("")),
        "api_key_id": given("api_key_id", F.lit("")),
        "policy_id": F.col("policy.id"),
        "policy_revision": F.col("policy.revision"),
        "auditor": given("auditor", F.lit(None).cast(VERDICT)),
        "auditor_error": given("auditor_error", F.lit("")),
        "latency_ms": given("latency_ms", F.lit(0)).cast("bigint"),
        "body_bytes": given("body_bytes", body_bytes(F.col("body")) if "body" in have else None),
        "content_sha256": given("content_sha256", content_sha256(F.col("body")) if "body" in have else None),
        "metadata": given("metadata", F.lit(None).cast("map<string,string>")),
    }
    return audited.select(*[values[c].alias(c) if c in values else F.col(c) for c in EVENT_COLUMNS])


def redact_evidence(events: DataFrame) -> DataFrame:
    """Drop matches and quoted evidence of redacted events; keep hashes, scores, versions."""
    redacted = F.col("decision") == "redact"
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    marked = F.map_concat(
        F.map_filter(metadata, lambda k, _: k != "evidence_redacted"),
        F.create_map(F.lit("evidence_redacted"), F.lit("true")),
    )
    return events.withColumns(
        {
            "matches": F.when(~redacted, F.col("matches")).otherwise(F.lit(None).cast(NO_MATCHES)),
            "auditor": F.when(
                redacted & F.col("auditor").isNotNull(), F.col("auditor").withField("evidence", F.lit(""))
            ).otherwise(F.col("auditor")),
            "metadata": F.when(redacted, marked).otherwise(F.col("metadata")),
        }
    )


def event_dedup(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First event per event_id; copies collapse before the shuffle.

    With ``order`` the earliest row in that order is kept, else any one of the copies.
    """
    if not order:
        return events.dropDuplicates(["event_id"])
    first = F.min_by(F.struct(*events.columns), F.struct(*order))
    return events.groupBy("event_id").agg(first.alias("e")).select("e.*")


def new_events(batch: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Events of a batch whose id is not stored yet, each once."""
    return event_dedup(batch).join(stored_ids.select("event_id").distinct(), "event_id", "left_anti")


# Status and code of each terminal step, in order of precedence.
OUTCOMES = [
    ("not_post", 405, "method_not_allowed"),
    ("identity_down", 503, "identity_unavailable"),
    ("key_invalid", 401, "invalid_api_key"),
    ("over_quota", 429, "rate_limit_exceeded"),
    ("too_large", 403, "request_too_large"),
    ("policy_block", 403, "policy_blocked"),
    ("auditor_down", 403, "auditor_unavailable"),
    ("auditor_block", 403, "auditor_blocked"),
    ("response_block", 403, "response_policy_blocked"),
    ("stream_block", 200, "stream_policy_blocked"),
]
ENFORCED = {"policy_block", "auditor_down", "auditor_block", "response_block", "stream_block"}


def request_outcome(requests: DataFrame, audit_enabled: bool = True) -> DataFrame:
    """Adds status, code and emits_event from one boolean column per step (see OUTCOMES).

    With auditing off the enforced steps are recorded but do not end the request.
    """
    status, code = F, F
    for flag, number, name in OUTCOMES:
        if flag in ENFORCED and not audit_enabled:
            continue
        status = status.when(F.col(flag), number)
        code = code.when(F.col(flag), name)
    early = [F.col(flag) for flag, _, _ in OUTCOMES[:5]]
    stopped = early[0]
    for flag in early[1:]:
        stopped = stopped | flag
    return requests.withColumns(
        {"status": status.otherwise(200), "code": code.otherwise("proxied"), "emits_event": ~stopped}
    )


def admin_events(operations: DataFrame) -> DataFrame:
    """Operation log (request_id, ts, path, operation, scope, outcome, version, authorization)."""
    actor = F.sha2(F.regexp_replace("authorization", "^Bearer ", ""), 256)
    metadata = F.create_map(
        F.lit("operation"), F.col("operation"), F.lit("scope"), F.col("scope"),
        F.lit("actor_hash"), actor, F.lit("outcome"), F.col("outcome"),
    )
    empty_policy = F.struct(F.lit("").alias("id"), F.lit(0).cast("bigint").alias("revision"))
    capture = ["capture_id"] if "capture_id" in operations.columns else []
    return to_events(
        operations.select(
            *capture, "request_id", "ts", "path", F.lit("admin").alias("tenant_id"),
            F.lit("admin").alias("direction"), F.col("outcome").alias("decision"),
            F.lit(0).alias("risk_score"), F.col("version").alias("rule_version"),
            F.lit(None).cast(NO_MATCHES).alias("matches"), empty_policy.alias("policy"),
            metadata.alias("metadata"), F.lit(0).alias("body_bytes"), F.lit("").alias("content_sha256"),
        )
    )


def latest_events(events: DataFrame, n: int, per: str | None = None, time: str = "event_time",
                  tie: str = "event_id") -> DataFrame:
    """The n newest events, overall or per value of ``per``.

    The per-key form ranks with a bound, which Spark applies before the shuffle too.
    """
    newest = [F.col(time).desc(), F.col(tie).desc()]
    if per is None:
        return events.orderBy(*newest).limit(n)
    w = W.partitionBy(per).orderBy(*newest)
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
