"""Transcript queries: assistant turns cut into 16-character deltas, in three wire formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import sse
from auditlake.operators.rules import Rule
from auditlake.sources.sink import materialize
from workload import data, sql

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


STEP = 16
SSE_RULES = [
    Rule("ther", "across deltas", "ther", "low", "monitor", 20),
    Rule("tion", "word ending", r"[a-z]tion\b", "low", "redact", 15, True),
    Rule("block", "stops the stream", "en der", "high", "block", 50),
]
SMALL_WINDOW = 48
SMALL_EVENT = 100


def transcripts(spark, sf):
    turns = data.spread(data.table(spark, sf, "conversations"), "conv_id", "turn")
    return transcripts_of(turns).drop("event_time")


def transcripts_of(turns):
    """Transcripts of a batch or streaming frame of conversation turns."""
    shape = F.col("conv_id") % 3
    count = F.ceil(F.length("text") / STEP).cast("int")

    def event(i):
        delta = data.json_string(F.substring("text", i * STEP + 1, F.lit(STEP)))
        return (
            F.when(shape == 0, F.concat(
                F.lit('data: {"choices":[{"index":'), i % 2, F.lit(',"delta":{"content":'), delta, F.lit("}}]}\n\n")))
            .when(shape == 1, F.concat(
                F.lit('event: delta\r\ndata: {"type":"response.output_text.delta","item_id":"m","output_index":0,"delta":'),
                delta, F.lit("}\r\n\r\n")))
            .otherwise(F.concat(F.lit(': note\ndata:{"choices":[{"text":'), delta, F.lit("}]}\n\n")))
        )

    events = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: i < count), event), "")
    return turns.select(
        F.concat_ws("/", F.lit("turn"), "conv_id", "turn").alias("capture_id"),
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.concat(F.lit("c"), F.col("conv_id") % 20).alias("tenant_id"),
        F.lit("/v1/chat/completions").alias("path"),
        F.concat(events, F.lit("data: [DONE]\n\n")).cast("binary").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("event_time"),
    )


_Q = sql.quoted("delta")
BASE = f"""turns AS (SELECT conv_id || '-' || turn AS request_id, 'c' || (conv_id % 20) AS tenant_id, conv_id % 3 AS shape, text
  FROM conversations),
deltas AS (SELECT request_id, tenant_id, shape, i AS seq, substr(text, i * {STEP} + 1, {STEP}) AS delta
  FROM (SELECT *, unnest(range((length(text) + {STEP - 1}) // {STEP})) AS i FROM turns)),
sse AS (SELECT request_id, tenant_id, shape, seq, delta, CASE shape
    WHEN 0 THEN 'data: {{"choices":[{{"index":' || (seq % 2) || ',"delta":{{"content":' || {_Q} || '}}}}]}}' || chr(10) || chr(10)
    WHEN 1 THEN 'event: delta' || chr(13) || chr(10) || 'data: {{"type":"response.output_text.delta","item_id":"m","output_index":0,"delta":' || {_Q} || '}}' || chr(13) || chr(10) || chr(13) || chr(10)
    ELSE ': note' || chr(10) || 'data:{{"choices":[{{"text":' || {_Q} || '}}]}}' || chr(10) || chr(10) END AS raw,
  CASE shape WHEN 0 THEN 'chat:choice:' || (seq % 2) || ':content'
    WHEN 1 THEN 'responses:response.output_text.delta:item:m:output:0:content:unknown' ELSE 'completion:choice:0:text' END AS channel,
  false AS done FROM deltas
  UNION ALL SELECT request_id, tenant_id, shape, (length(text) + {STEP - 1}) // {STEP}, NULL, 'data: [DONE]' || chr(10) || chr(10), NULL, true FROM turns),
frags AS (SELECT * FROM sse WHERE NOT done)"""


@query("sse_source", f"""WITH {BASE} SELECT request_id, sum(strlen(raw))::bigint AS bytes,
  sha256(string_agg(raw, '' ORDER BY seq)) AS digest FROM sse GROUP BY ALL""")
def sse_source(spark, sf):
    return transcripts(spark, sf).select(
        "request_id", F.octet_length("body").cast("bigint").alias("bytes"), F.sha2("body", 256).alias("digest")
    )


@query("sse_split", f"WITH {BASE} SELECT request_id, seq, strlen(raw) AS bytes, sha256(raw) AS digest FROM sse")
def sse_split(spark, sf):
    return sse.sse_split(transcripts(spark, sf)).select(
        "request_id", "seq", F.octet_length("raw").alias("bytes"), F.sha2("raw", 256).alias("digest")
    )


@query("sse_data", f"""WITH {BASE} SELECT request_id, seq, sha256(CASE WHEN done THEN '[DONE]' ELSE
  trim(regexp_extract(raw, 'data: ?([^\\r\\n]*)', 1)) END) AS digest FROM sse""")
def sse_data(spark, sf):
    return sse.sse_data(sse.sse_split(transcripts(spark, sf))).select(
        "request_id", "seq", F.sha2("data", 256).alias("digest")
    )


@query("sse_done", f"WITH {BASE} SELECT request_id, count(*) AS events, count(*) FILTER (done) AS done FROM sse GROUP BY ALL")
def sse_done(spark, sf):
    events = sse.sse_data(sse.sse_split(transcripts(spark, sf)))
    return events.groupBy("request_id").agg(F.count("*").alias("events"), F.count_if("done").alias("done"))


def fragments(spark, sf):
    return sse.sse_fragments(sse.sse_split(transcripts(spark, sf)))


@query("chat_fragments", f"WITH {BASE} SELECT request_id, seq, 0 AS frag, channel, delta AS text FROM frags WHERE shape <> 1")
def chat_fragments(spark, sf):
    found = fragments(spark, sf).filter(~F.col("channel").startswith("responses:"))
    return found.select("request_id", "seq", "frag", "channel", F.col("fragment").cast("string").alias("text"))


@query("response_fragments", f"WITH {BASE} SELECT request_id, seq, channel, delta AS text FROM frags WHERE shape = 1")
def response_fragments(spark, sf):
    found = fragments(spark, sf).filter(F.col("channel").startswith("responses:"))
    return found.select("request_id", "seq", "channel", F.col("fragment").cast("string").alias("text"))


WINDOWS_SQL = f"""cum AS (SELECT *, coalesce(sum(strlen(delta)) OVER (PARTITION BY request_id, channel ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM frags),
whole AS (SELECT request_id, channel, hex(encode(string_agg(delta, '' ORDER BY seq))) AS hex FROM frags GROUP BY ALL),
windows AS (SELECT c.request_id, c.channel, c.seq, c.delta,
    substr(w.hex, 2 * greatest(0, before - {SMALL_WINDOW}) + 1, 2 * (least(before, {SMALL_WINDOW}) + strlen(delta))) AS hex
  FROM cum c JOIN whole w USING (request_id, channel))"""


@query("channel_window", f"WITH {BASE}, {WINDOWS_SQL} SELECT request_id, channel, seq, hex FROM windows")
def channel_window(spark, sf):
    found = sse.channel_window(materialize(fragments(spark, sf), "fragments"), window=SMALL_WINDOW)
    return found.select("request_id", "channel", "seq", F.hex("window").alias("hex"))


def audited(spark, sf):
    # Offsets and windows both read the fragments, a fraction of the transcripts' size.
    parsed = materialize(fragments(spark, sf), "fragments")
    return sse.fragment_audit(parsed, SSE_RULES, data.policies(spark), rule_version="sse-1")


# No channel of these tables is longer than the default window, so a window is the whole
# text of its channel so far.
AUDIT_SQL = ",\n".join([
    f"WITH {BASE}",
    """grown AS (SELECT request_id, tenant_id, seq, channel, delta, raw, request_id || '/' || seq AS k, 'response' AS direction, '/v1/chat/completions' AS path,
  string_agg(delta, '') OVER (PARTITION BY request_id, channel ORDER BY seq) AS body FROM frags)""",
    f"texts AS (SELECT *, CASE WHEN json_valid(body) THEN '' ELSE {sql.normal('body')} END AS text FROM grown)",
    sql.rules("rules", SSE_RULES), sql.policies(), sql.hits("texts", "k"), sql.scored("texts", "k"),
    sql.resolved("scored", "k"), sql.DECIDED,
])
CUTS_SQL = f"""big AS (SELECT request_id, min(seq) AS seq FROM sse WHERE strlen(raw) > {SMALL_EVENT} GROUP BY 1),
ends AS (SELECT request_id, seq, 0 AS frag, 'stream_policy_blocked' AS code FROM decided WHERE decision = 'block'),
cuts AS (SELECT request_id, min(seq) AS cut_seq FROM ends GROUP BY 1)"""


@query("stream_audit", AUDIT_SQL + " SELECT request_id, seq, channel, risk_score, match_ids, decision, policy_id FROM decided")
def stream_audit(spark, sf):
    return audited(spark, sf).select(
        "request_id", "seq", "channel", "risk_score",
        F.array_join(F.transform("matches", lambda m: m["rule_id"]), ",").alias("match_ids"), "decision",
        F.col("policy.id").alias("policy_id"),
    )


@query("stream_cut", AUDIT_SQL + f""", {CUTS_SQL}
SELECT d.request_id, d.seq, d.decision, d.seq = c.cut_seq AS ended FROM decided d LEFT JOIN cuts c USING (request_id)
WHERE c.cut_seq IS NULL OR d.seq <= c.cut_seq""")
def stream_cut(spark, sf):
    rows = materialize(audited(spark, sf).select("capture_id", "request_id", "seq", "frag", "decision"), "decisions")
    kept = sse.before_cut(rows, sse.stream_cut(rows), True)
    return kept.select("request_id", "seq", "decision", (F.col("seq") == F.col("cut_seq")).alias("ended"))


@query("oversize_cut", f"""WITH {BASE} SELECT 'turn/' || replace(request_id, '-', '/') AS capture_id, min(seq) AS cut_seq FROM sse WHERE strlen(raw) > {SMALL_EVENT} GROUP BY 1""")
def oversize_cut(spark, sf):
    return sse.oversize_cut(sse.sse_split(transcripts(spark, sf)), SMALL_EVENT)


@query("delivered_transcript", AUDIT_SQL + f""", {CUTS_SQL},
first AS (SELECT request_id, min_by(code, (seq, rank)) AS code, min(seq) AS cut_seq FROM (
  SELECT request_id, seq, 'sse_event_too_large' AS code, 0 AS rank FROM big UNION ALL SELECT request_id, seq, code, 1 FROM ends) GROUP BY 1)
SELECT s.request_id, f.code, sha256(coalesce(string_agg(s.raw, '' ORDER BY s.seq) FILTER (f.cut_seq IS NULL OR s.seq < f.cut_seq), '') ||
  CASE WHEN f.code IS NULL THEN '' ELSE 'event: gateway.security_terminated' || chr(10) ||
    'data: {{"error":{{"type":"security_termination","code":"' || f.code || '","message":"' ||
    CASE f.code WHEN 'sse_event_too_large' THEN 'stream event exceeds configured size limit' ELSE 'stream response blocked by audit policy' END ||
    '","request_id":"' || s.request_id || '"}}}}' || chr(10) || chr(10) END) AS digest
FROM sse s LEFT JOIN first f USING (request_id) GROUP BY s.request_id, f.code""")
def delivered_transcript(spark, sf):
    source = transcripts(spark, sf)
    too_large = sse.oversize_cut(sse.sse_split(source), SMALL_EVENT)
    cuts = sse.stream_cut(audited(spark, sf), too_large)
    return sse.delivered_transcript(source, cuts).select("request_id", "code", F.sha2("delivered", 256).alias("digest"))
