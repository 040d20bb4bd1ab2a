"""Explicit schemas of every table the engine reads or writes (DDL strings)."""

RULE = (
    "struct<id:string,name:string,pattern:string,severity:string,"
    "action:string,weight:int,regex:boolean>"
)
RULE_SET = (
    "version string, scope string, status string, source string, "
    f"rules array<{RULE}>, created_at timestamp, published_at timestamp"
)
POLICY_FIELDS = (
    "id string, scope string, route_path string, direction string, monitor_at int, "
    "intervention_at int, intervention_action string, auditor_failure_mode string, "
    "revision bigint"
)
CONFIG = (
    f"struct<rules:array<{RULE}>,policies:array<struct<scope:string,route_path:string,"
    "direction:string,monitor_at:int,intervention_at:int,intervention_action:string,"
    "auditor_failure_mode:string>>>"
)
TRAFFIC = (
    "capture_id string, request_id string, tenant_id string, api_key_id string, direction string, "
    "model string, path string, body binary, ts timestamp"
)
MATCH = (
    "struct<rule_id:string,name:string,severity:string,action:string,"
    "weight:int,evidence:string>"
)
VERDICT = (
    "struct<verdict:string,risk_score:int,confidence:double,categories:array<string>,"
    "evidence:string,model:string,version:string>"
)
EVENT = (
    "schema_version string, event_id string, event_time timestamp, request_id string, "
    "tenant_id string, direction string, path string, model string, decision string, "
    "risk_score int, rule_version string, api_key_id string, policy_id string, "
    f"policy_revision bigint, matches array<{MATCH}>, auditor {VERDICT}, "
    "auditor_error string, latency_ms bigint, body_bytes int, content_sha256 string, "
    "metadata map<string,string>"
)
EVENT_COLUMNS = [
    "schema_version", "event_id", "event_time", "request_id", "tenant_id", "direction",
    "path", "model", "decision", "risk_score", "rule_version", "api_key_id", "policy_id",
    "policy_revision", "matches", "auditor", "auditor_error", "latency_ms", "body_bytes",
    "content_sha256", "metadata",
]
