import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import sse
from auditlake.operators.rules import Rule
from auditlake.schemas import POLICY_FIELDS
from auditlake.sources.traffic import sse_source

PATH = "/v1/chat/completions"


def transcripts(spark, bodies):
    rows = [(f"r{i}", "t", PATH, body if isinstance(body, bytes) else body.encode()) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "request_id string, tenant_id string, path string, body binary")


def events(spark, body):
    return sse.sse_data(sse.sse_split(transcripts(spark, [body]))).orderBy("seq").collect()


def fragments(spark, data):
    found = sse.sse_fragments(sse.sse_split(transcripts(spark, [f"data: {data}\n\n"])))
    return {r.channel: bytes(r.fragment).decode() for r in found.collect()}


def test_split_keeps_every_byte(spark):
    raw = 'retry: 20\r\ndata: [1,\r\ndata:2,\r\ndata:  3]\r\n\r\n\r\nevent: end\ndata:\t[DONE] \n\ntail'
    found = events(spark, raw)
    assert b"".join(bytes(e.raw) for e in found) == raw.encode()
    assert [bytes(e.data) for e in found] == [b"[1,\n2,\n 3]", b"", b"\t[DONE] ", b""]
    assert [e.done for e in found] == [False, False, True, False]


@pytest.mark.parametrize("body,data", [
    ("id: 9\n:\n\ndata: two words \r\n\ndata: a:b", [b"", b"two words ", b"a:b"]),
    ("\n\r\ndataset: 1\ndata\ndata:  two\n", [b"", b"", b"\n two"]), (b"data: \xff\xfe\n\ndata: x", [b"\xff\xfe", b"x"]),
])
def test_data_lines(spark, body, data):
    found = events(spark, body)
    assert [bytes(e.data) for e in found] == data
    assert b"".join(bytes(e.raw) for e in found) == (body if isinstance(body, bytes) else body.encode())


R = "response.output_text.delta"


@pytest.mark.parametrize("data,want", [
    (r'{"choices":[{"index":7,"delta":{"tool_calls":[{"function":{"arguments":"[1"}},{"index":9,"function":{"arguments":"]\u00e9"}}]}},{"index":5,"delta":{"content":"q","function_call":{"arguments":"\"k\""}},"text":"w"}]}',
     {"chat:choice:7:tool:0:arguments": "[1", "chat:choice:7:tool:9:arguments": "]é", "chat:choice:5:content": "q",
      "chat:choice:5:function_call:arguments": '"k"', "completion:choice:5:text": "w"}),
    ('{"CHOICES":[{"Index":6,"dElta":{"Content":"the \\"Content\\": stays"}}]}', {"chat:choice:6:content": 'the "Content": stays'}),
    (f'{{"Type":"{R}","Item_ID":"n","DELTA":"Delta"}}', {f"responses:{R}:item:n:output:unknown:content:unknown": "Delta"}),
    ('{"choices":[{"index":3,"text":"old form"}]}', {"completion:choice:3:text": "old form"}),
    ('{"choices":[null,{"delta":{"content":"b"}}]}', {"chat:choice:1:content": "b"}),
    ('{"choices":[{"delta":{"role":"assistant"}}]}', {}), ('{"choices":[{"delta":{"content":1}}]}', {}),
    ('{"choices":[{"index":1.0,"delta":{"content":"a"}}]}', {}), ('{"choices":[{"delta":{"content":"a"}},7]}', {}),
    ('{"choices":[{"delta":{"content":"a","tool_calls":{}}}]}', {}), ('{"choices":[{"delta":{"content":"a"}}]} x', {}),
    (f'{{"type":"{R}","item_id":"m","output_index":2,"content_index":3,"delta":"a"}}', {f"responses:{R}:item:m:output:2:content:3": "a"}),
    (f'{{"type":"{R}","delta":"a"}}', {f"responses:{R}:item:unknown:output:unknown:content:unknown": "a"}),
    ('{"type":"response.reasoning_summary_text.delta","item_id":"i","output_index":9,"summary_index":10,"delta":"s"}',
     {"responses:response.reasoning_summary_text.delta:item:i:output:9:summary:10": "s"}),
    ('{"type":"response.function_call_arguments.delta","item_id":"f","output_index":4,"delta":"x"}',
     {"responses:response.function_call_arguments.delta:item:f:output:4": "x"}),
    ('{"type":"response.created","response":{"id":"r"}}', {}), (f'{{"type":"{R}","delta":0}}', {}), (f'{{"type":"{R}","delta":""}}', {}),
])
def test_fragments(spark, data, want):
    assert fragments(spark, data) == want


def test_windows_equal_brute_force(spark):
    rng, rows = random.Random(5), []
    for seq in range(300):
        rows.append(("r", rng.choice(["a", "a", "b"]), seq, 0, bytes(rng.choices(b"xyz\xc3\xa9", k=rng.choice([1, 2, 3, 40, 90])))))
    frame = spark.createDataFrame(rows, "request_id string, channel string, seq int, frag int, fragment binary")
    for width in (8, 64):
        got = {r.seq: (bytes(r.fragment), bytes(r.window)) for r in sse.channel_window(frame, ["request_id"], width).collect()}
        seen = {}
        for _, channel, seq, _, chunk in rows:
            assert got[seq] == (chunk, seen.get(channel, b"")[-width:] + chunk)
            seen[channel] = seen.get(channel, b"") + chunk
        assert len(got) == len(rows)


def chat(*texts, done=True):
    lines = "".join(f'data: {{"choices":[{{"delta":{{"content":"{t}"}}}}]}}\n\n' for t in texts)
    return lines + ("data: [DONE]\n\n" if done else "")


def run(spark, bodies, rules, max_bytes=sse.MAX_EVENT_BYTES):
    source = transcripts(spark, bodies)
    policies = spark.createDataFrame([], POLICY_FIELDS)
    split = sse.sse_split(source)
    audited = sse.fragment_audit(sse.sse_fragments(split), rules, policies)
    cuts = sse.stream_cut(audited, sse.oversize_cut(split, max_bytes))
    delivered = {r.request_id: bytes(r.delivered).decode() for r in sse.delivered_transcript(source, cuts).collect()}
    return delivered, sse.stream_events(audited, cuts).collect(), sse.oversize_events(source, cuts, policies).collect()


END = ('event: gateway.security_terminated\ndata: {"error":{"type":"security_termination","code":"%s",'
       '"message":"%s","request_id":"r0"}}\n\n')


def test_block_across_events(spark):
    delivered, events, _ = run(spark, [chat("form", "ula x", "more"), chat("fine")], [Rule("n", "", "formula", action="block", weight=40)])
    assert delivered["r0"] == chat("form", done=False) + END % ("stream_policy_blocked", "stream response blocked by audit policy")
    assert delivered["r1"] == chat("fine")
    mine = sorted((e for e in events if e.request_id == "r0"), key=lambda e: e.risk_score)
    assert [e.decision for e in mine] == ["allow", "block"]
    assert mine[1].metadata == {"sse": "true", "sse_channel": "chat:choice:0:content", "stream_termination_reason": "stream_policy_blocked"}


def test_redacted_fragment(spark):
    delivered, events, _ = run(spark, [chat("recipe")], [Rule("n", "", "recipe", action="redact", weight=55)])
    assert delivered["r0"] == chat("recipe")
    (event,) = events
    assert event.decision == "redact" and event.matches is None and event.body_bytes == 6
    assert event.metadata == {"sse": "true", "sse_channel": "chat:choice:0:content", "evidence_redacted": "true"}


def test_oversize_event(spark):
    delivered, events, ended = run(spark, [": n\n\ndata: " + "é" * 60 + "\n\n" + chat("x")], [], 100)
    assert delivered["r0"] == ": n\n\n" + END % ("sse_event_too_large", "stream event exceeds configured size limit")
    assert events == [] and [(e.decision, e.risk_score, e.body_bytes) for e in ended] == [("block", 0, 0)]


def test_streams_with_one_request_id_stay_apart(spark):
    rows = [("c1", "same", "a", PATH, chat("form", "b").encode()), ("c2", "same", "b", PATH, chat("ula", "x").encode()),
            ("c3", "same", "a", PATH, chat("formula").encode())]
    source = spark.createDataFrame(rows, "capture_id string, request_id string, tenant_id string, path string, body binary")
    policies = spark.createDataFrame([], POLICY_FIELDS)
    audited = sse.fragment_audit(sse.sse_fragments(sse.sse_split(source)), [Rule("n", "", "formula", action="block", weight=40)], policies)
    cuts = sse.stream_cut(audited)
    delivered = {r.capture_id: r.code for r in sse.delivered_transcript(source, cuts).collect()}
    assert delivered == {"c1": None, "c2": None, "c3": "stream_policy_blocked"}
    assert len({e.event_id for e in sse.stream_events(audited, cuts).collect()}) == 5


def test_rechunked_transcript_gives_the_same_text(spark):
    text = "The quick brown fox jumps over the lazy dog"
    rng, bodies = random.Random(2), []
    for _ in range(5):
        cuts = sorted(rng.sample(range(1, len(text)), 6))
        bodies.append(chat(*[text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]))
    rows = sse.channel_window(sse.sse_fragments(sse.sse_split(transcripts(spark, bodies))), ["request_id"])
    last = rows.groupBy("request_id").agg(F.max_by("window", "seq").alias("w")).collect()
    assert {bytes(r.w).decode() for r in last} == {text}


def test_files(spark, tmp_path):
    (tmp_path / "one.sse").write_bytes(b"data: a\r\n\r\n")
    assert [(r.request_id, bytes(r.body)) for r in sse_source(spark, str(tmp_path)).collect()] == [("one", b"data: a\r\n\r\n")]
