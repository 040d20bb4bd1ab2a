"""Shared SQL of the checks (DuckDB dialect)."""

from __future__ import annotations

from workload import data

WS = (
    r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def quoted(expr: str) -> str:
    """A text as a JSON string."""
    return f"substr(to_json([{expr}])::varchar, 2, length(to_json([{expr}])::varchar) - 2)"


def normal(expr: str) -> str:
    return f"lower(trim(regexp_replace({expr}, '{WS}', ' ', 'g')))"


ROUTE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in data.ROUTE_OF_LANG.items()) + " ELSE '/v1/models' END"

TRAFFIC = f"""traffic AS (
  SELECT doc_id, doc_id::varchar AS request_id, source AS tenant_id, 'key-' || source AS api_key_id,
         'request' AS direction, {ROUTE} AS path, text AS body,
         make_timestamp((1704067200 + doc_id) * 1000000) AS ts
  FROM documents)"""

CHAT = f"""'{{"model":' || {quoted("'m-' || lang")} || ',"stream":true,"messages":[{{"role":"user","content":' || {quoted("text")} || '}}]}}'"""
NESTED = f"""'{{"model":7,"input":[1,null,' || {quoted("text")} || ',{{"deep":["a\\n\\u0041",{{"k":"' || 'm-' || lang || '"}}]}}],"n":1.5}}'"""
WRAPPED = f"""wrapped AS (
  SELECT doc_id, doc_id::varchar AS request_id, source AS tenant_id, {ROUTE} AS path,
         CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN {CHAT} WHEN 2 THEN {NESTED} ELSE {CHAT} || ' tail' END AS body
  FROM documents)"""

# String values in document order, or the body itself.
JSON_TEXT = """json_texts AS (
  SELECT w.doc_id, w.request_id, w.tenant_id, w.path, w.body,
         CASE WHEN json_valid(w.body) THEN coalesce(s.t, '') ELSE w.body END AS raw_text
  FROM wrapped w LEFT JOIN (
    SELECT v.request_id, string_agg(j.value ->> '$', chr(10) ORDER BY j.id) AS t
    FROM (SELECT request_id, CASE WHEN json_valid(body) THEN body ELSE 'null' END AS doc FROM wrapped) v,
         json_tree(v.doc) j
    WHERE j.type = 'VARCHAR' GROUP BY v.request_id) s ON s.request_id = w.request_id)"""


def rules(name: str = "rules", items=data.RULES) -> str:
    rows = []
    for pos, r in enumerate(items):
        if r.pattern:
            rows.append(
                f"({pos}, {q(r.id)}, {q(r.pattern)}, {q(r.action or 'monitor')}, {r.weight if r.weight > 0 else 10}, {q(r.regex)})"
            )
    return f"{name}(pos, id, pattern, action, weight, is_regex) AS (VALUES {', '.join(rows)})"


RANK = "CASE {0} WHEN 'allow' THEN 0 WHEN 'monitor' THEN 1 WHEN 'redact' THEN 2 WHEN 'block' THEN 3 ELSE -1 END"
UNRANK = "CASE {0} WHEN 0 THEN 'allow' WHEN 1 THEN 'monitor' WHEN 2 THEN 'redact' ELSE 'block' END"


def hits(source: str, key: str, rule_table: str = "rules") -> str:
    """hits: one row per (text, rule); ``source`` has ``key`` and normalised ``text``."""
    return f"""hits AS (
  SELECT t.{key}, r.pos, r.id, r.action, r.weight, r.is_regex,
         CASE WHEN r.is_regex THEN 0 ELSE strpos(t.text, lower(r.pattern)) + length(r.pattern) END AS end_pos,
         CASE WHEN r.is_regex THEN 0 ELSE length(r.pattern) END AS len
  FROM {source} t JOIN {rule_table} r
    ON CASE WHEN r.is_regex THEN regexp_matches(t.text, r.pattern) ELSE contains(t.text, lower(r.pattern)) END)"""


def scored(source: str, key: str) -> str:
    rank = RANK.format("action")
    return f"""scored AS (
  SELECT t.*, coalesce(h.score, 0) AS risk_score, coalesce(h.ids, '') AS match_ids, coalesce(h.top, -1) AS top
  FROM {source} t LEFT JOIN (
    SELECT {key}, least(sum(weight), 100)::int AS score, max({rank}) AS top,
           string_agg(id, ',' ORDER BY is_regex, end_pos, -len, pos) AS ids
    FROM hits GROUP BY {key}) h ON h.{key} = t.{key})"""


def policies(items=data.POLICIES) -> str:
    rows = []
    for (pid, scope, path, direction, monitor, intervene, action, mode, revision) in items:
        values = [pid, scope or "global", path or "*", direction or "request", monitor if monitor > 0 else 30,
                  intervene if intervene > 0 else 80, action or "block", mode or "fail_open",
                  revision if revision > 0 else 1]
        rows.append("(" + ", ".join(q(v) for v in values) + ")")
    return (
        "policies(policy_id, p_scope, p_path, p_direction, monitor_at, intervention_at, p_action, p_mode, p_revision) AS (VALUES "
        + ", ".join(rows) + ")"
    )


def resolved(source: str, key: str) -> str:
    return f"""resolved AS (
  SELECT * EXCLUDE (rn, p_scope, p_path, p_direction) REPLACE (
      coalesce(policy_id, '') AS policy_id, coalesce(monitor_at, 30) AS monitor_at,
      coalesce(intervention_at, 80) AS intervention_at, coalesce(p_action, 'block') AS p_action,
      coalesce(p_mode, 'fail_open') AS p_mode, coalesce(p_revision, 1) AS p_revision)
  FROM (SELECT t.*, p.*, row_number() OVER (PARTITION BY t.{key} ORDER BY
            (CASE WHEN p.p_scope = 'global' THEN 0 ELSE 4 END) + (CASE WHEN p.p_path = '*' THEN 0 ELSE 1 END) DESC) AS rn
        FROM {source} t LEFT JOIN policies p ON p.p_direction = t.direction
          AND p.p_scope IN ('global', 'tenant:' || t.tenant_id) AND p.p_path IN ('*', t.path))
  WHERE rn = 1)"""


BASE = "CASE WHEN risk_score >= intervention_at THEN p_action WHEN risk_score >= monitor_at THEN 'monitor' ELSE 'allow' END"
DECIDED = f"""decided AS (
  SELECT *, {UNRANK.format("greatest(" + RANK.format("base") + ", top)")} AS decision
  FROM (SELECT *, {BASE} AS base FROM resolved))"""


def audited(traffic_cte: str, key: str = "request_id", rule_items=data.RULES, text: str | None = None) -> str:
    """WITH list up to ``decided``; ``traffic_cte`` defines ``traffic``."""
    text = text or normal("body")
    return ",\n".join([
        traffic_cte, f"texts AS (SELECT *, {text} AS text FROM traffic)", rules("rules", rule_items), policies(),
        hits("texts", key), scored("texts", key), resolved("scored", key), DECIDED,
    ])


AUDIT = "WITH " + audited(TRAFFIC)

VERDICTS = """verdicts AS (SELECT doc_id::varchar AS request_id, CASE WHEN toxic = 1 THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN toxic = 1 THEN 100 ELSE 0 END AS v_score FROM labels)"""
VERDICTED = f"""{VERDICTS}, joined AS (
  SELECT d.*, v.verdict, v.v_score FROM decided d LEFT JOIN verdicts v ON v.request_id = d.request_id),
promoted AS (
  SELECT * REPLACE (CASE WHEN decision = 'monitor' AND (coalesce(verdict = 'block' OR v_score >= intervention_at, false)
      OR (verdict IS NULL AND p_mode = 'fail_closed')) THEN 'block' ELSE decision END AS decision),
    decision AS first_decision,
    CASE WHEN decision = 'monitor' THEN verdict END AS auditor_verdict,
    CASE WHEN decision = 'monitor' AND verdict IS NULL THEN 'auditor unavailable' ELSE '' END AS auditor_error
  FROM joined)"""
