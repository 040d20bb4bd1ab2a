"""Server-sent-event transcripts: split, extract, window, audit, cut, deliver.

Bytes are handled as ISO-8859-1 text (one character per byte), so splitting and sizes are
exact for any input; text is decoded as UTF-8 only where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import WHITESPACE, as_text, json_valid, with_normal_text
from auditlake.operators import events as ev
from auditlake.operators import policy as pol
from auditlake.operators import rules as rul
from auditlake.plans.lookup import salted_lookup
from auditlake.plans.segmented import running

WINDOW_BYTES = 16 << 10
MAX_EVENT_BYTES = 256 << 10
LATIN1 = "ISO-8859-1"
EVENTS_PER_BUCKET = 4096

# Event types of the responses format, with the suffix of their channel.
RESPONSE_TYPES = {
    "response.output_text.delta": "content",
    "response.refusal.delta": "content",
    "response.reasoning_text.delta": "content",
    "response.reasoning_summary_text.delta": "summary",
    "response.function_call_arguments.delta": "",
}
# Name and text of the terminal event.
TERMINAL = "gateway.security_terminated"
BLOCKED, TOO_LARGE = "stream_policy_blocked", "sse_event_too_large"
MESSAGES = {
    BLOCKED: "stream response blocked by audit policy",
    TOO_LARGE: "stream event exceeds configured size limit",
}


def stream_keys(rows: DataFrame) -> list[str]:
    """What names a stream: its capture, as request_id is the caller's choice; request_id where there is none."""
    return ["capture_id"] if "capture_id" in rows.columns else ["request_id"]


def _pieces(body: Column) -> Column:
    """Raw events, terminators kept; the piece after the last terminator may be empty."""
    return F.split(F.decode(body, LATIN1), r"(?<=(?:\n|\A)\r?\n)")


def sse_split(transcripts: DataFrame) -> DataFrame:
    """One row per event: seq, raw bytes. Other columns but ``body`` are kept."""
    keep = [c for c in transcripts.columns if c != "body"]
    # The outer form, as the plain one makes Spark split once more to test for emptiness.
    rows = transcripts.select(*keep, F.posexplode_outer(_pieces(F.col("body"))).alias("seq", "__piece"))
    return rows.filter(F.col("__piece") != "").select(
        *keep, "seq", F.encode("__piece", LATIN1).alias("raw")
    )


def sse_data(events: DataFrame) -> DataFrame:
    """Adds ``data`` (data lines joined by newline) and ``done``."""
    lines = F.split(F.decode("raw", LATIN1), "\n")
    bare = F.transform(lines, lambda line: F.regexp_replace(line, r"\r\z", ""))
    ours = F.filter(bare, lambda line: (line == "data") | line.startswith("data:"))
    # 'data' and 'data:' are both empty; one leading space is not part of the value.
    values = F.transform(ours, lambda line: F.regexp_replace(line, r"\Adata(?:: ?)?", ""))
    data = F.encode(F.array_join(values, "\n"), LATIN1)
    done = F.regexp_replace(as_text(F.col("data")), f"^{WHITESPACE}+|{WHITESPACE}+$", "") == "[DONE]"
    return events.withColumn("data", data).withColumn("done", done)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _empty(value: Column) -> Column:
    """Absent and null fields count as empty, not as a wrong type."""
    return value.isNull() | F.is_variant_null(value)


def _is_leaf(value: Column, kind: str) -> Column:
    return _empty(value) | (F.schema_of_variant(value) == kind)


def _is_object(value: Column) -> Column:
    return _empty(value) | F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _text(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def _array(value: Column) -> Column:
    """Elements; no elements for an empty field, null for a wrong type."""
    none = F.array().cast("array<variant>")
    return F.when(_empty(value), none).otherwise(F.try_variant_get(value, "$", "array<variant>"))


def _index(value: Column, position: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "bigint").cast("string"), position.cast("string"))


def _fragment(channel: Column, text: Column) -> Column:
    return F.struct(channel.alias("channel"), text.alias("text"))


def _tool_call(tool: Column) -> Column:
    ok = _is_object(tool) & _is_object(_at(tool, "$.function"))
    return F.struct(
        ok.alias("ok"), _at(tool, "$.index").alias("index"), _at(tool, "$.function.arguments").alias("text")
    )


def _choice(choice: Column) -> Column:
    ok = (
        _is_object(choice) & _is_object(_at(choice, "$.delta")) & _is_object(_at(choice, "$.delta.function_call"))
    )
    return F.struct(
        ok.alias("ok"), _at(choice, "$.index").alias("index"), _at(choice, "$.text").alias("text"),
        _at(choice, "$.delta.content").alias("content"),
        _at(choice, "$.delta.function_call.arguments").alias("call"),
        F.transform(_array(_at(choice, "$.delta.tool_calls")), _tool_call).alias("tools"),
    )


def _choice_ok(c: Column) -> Column:
    leaves = _is_leaf(c["index"], "BIGINT")
    for name in ("text", "content", "call"):
        leaves = leaves & _is_leaf(c[name], "STRING")
    tools = F.forall(
        c["tools"], lambda t: t["ok"] & _is_leaf(t["index"], "BIGINT") & _is_leaf(t["text"], "STRING")
    )
    return c["ok"] & leaves & F.coalesce(tools, F.lit(False))


def _choice_fragments(c: Column, position: Column) -> Column:
    n = _index(c["index"], position)
    chat = F.concat(F.lit("chat:choice:"), n)
    tools = F.transform(
        c["tools"],
        lambda t, i: _fragment(
            F.concat(chat, F.lit(":tool:"), _index(t["index"], i), F.lit(":arguments")), _text(t["text"])
        ),
    )
    return F.concat(
        F.array(
            _fragment(F.concat(chat, F.lit(":content")), _text(c["content"])),
            _fragment(F.concat(chat, F.lit(":function_call:arguments")), _text(c["call"])),
        ),
        tools,
        F.array(_fragment(F.concat(F.lit("completion:choice:"), n, F.lit(":text")), _text(c["text"]))),
    )


_TOP = ["type", "item_id", "delta", "output_index", "content_index", "summary_index", "choices"]


def _response_fragments(top: Column) -> Column:
    kind, delta, item = _text(top["type"]), _text(top["delta"]), _text(top["item_id"])
    unknown = F.lit("unknown")
    head = F.concat(
        F.lit("responses:"), kind, F.lit(":item:"), F.when(item == "", "unknown").otherwise(item),
        F.lit(":output:"), _index(top["output_index"], unknown),
    )
    channel = F
    for name, suffix in RESPONSE_TYPES.items():
        tail = F.concat(F.lit(f":{suffix}:"), _index(top[f"{suffix}_index"], unknown)) if suffix else F.lit("")
        channel = channel.when(kind == name, F.concat(head, tail))
    known = kind.isin(list(RESPONSE_TYPES)) & (delta != "")
    return F.when(known, F.array(_fragment(channel.otherwise(""), delta)))


# Names of the fields that are read.
FIELDS = [*_TOP, "index", "text", "content", "function_call", "arguments", "tool_calls", "function"]
_ANY_CASE = r'(?<!\\)"(?=[A-Za-z_]*[A-Z])(?i:%s)"[ \t\r\n]*:'


def _lower_names(text: Column) -> Column:
    """Field names in any case become lower case, as readers that ignore case see them.

    A quote that is not escaped and a colon behind the name tell a name from a value.
    """
    lowered = text
    for name in FIELDS:
        lowered = F.regexp_replace(lowered, _ANY_CASE % name, f'"{name}":')
    return F.when(text.rlike(_ANY_CASE % "|".join(FIELDS)), lowered).otherwise(text)


def extract_fragments(events: DataFrame) -> DataFrame:
    """Adds ``fragments``: array<struct<channel,text>> of one event, in reading order.

    A non-empty ``type`` switches to the responses format; otherwise chat and legacy
    completion choices are read. One field of the wrong type voids the whole event. Every
    step is a projection of its own, so that each JSON path is read once.
    """
    text, top, choices = F.col("__text"), F.col("__top"), F.col("__choices")
    json = F.when(~F.col("done") & text.rlike(r"^[ \t\r\n]*\{") & json_valid(text), F.try_parse_json(text))
    ok = top["type"].isNotNull() | top["choices"].isNotNull()
    for name in ("type", "item_id", "delta"):
        ok = ok & _is_leaf(top[name], "STRING")
    for name in ("output_index", "content_index", "summary_index"):
        ok = ok & _is_leaf(top[name], "BIGINT")
    is_response = _text(top["type"]) != ""
    chat = F.when(
        F.forall(choices, _choice_ok),
        F.filter(F.flatten(F.transform(choices, _choice_fragments)), lambda f: f["text"] != ""),
    )
    found = F.when(ok, F.when(is_response, _response_fragments(top)).otherwise(chat))
    empty = F.array().cast("array<struct<channel:string,text:string>>")
    return (
        events.withColumn("__text", _lower_names(as_text(F.col("data"))))
        .withColumn("__doc", json)
        .withColumn("__top", F.struct(*[_at(F.col("__doc"), f"$.{n}").alias(n) for n in _TOP]))
        .withColumn("__choices", F.transform(_array(top["choices"]), _choice))
        .withColumn("fragments", F.coalesce(found, empty))
        .drop("__text", "__doc", "__top", "__choices")
    )


def sse_fragments(events: DataFrame) -> DataFrame:
    """One row per fragment: seq, frag (position in its event), channel, text bytes."""
    parsed = extract_fragments(sse_data(events))
    keep = [c for c in events.columns if c not in ("raw", "data", "done")]
    rows = parsed.select(*keep, F.posexplode_outer("fragments").alias("frag", "f"))
    return rows.filter(F.col("f").isNotNull()).select(*keep, "frag", F.col("f.channel").alias("channel"),
                       F.col("f.text").cast("binary").alias("fragment"))


def channel_window(
    fragments: DataFrame, keys: Sequence[str] | None = None, window: int = WINDOW_BYTES
) -> DataFrame:
    """Adds ``window``: the last W bytes of the channel before a fragment, plus the fragment.

    Fragments get byte offsets in their channel, and the channel is cut into blocks of 2W
    bytes. Each block also receives the fragments that reach into its first window, so every
    block is assembled on its own and holds a bounded number of bytes, however long the
    channel is.
    """
    keys = list(keys or stream_keys(fragments))
    block = 2 * window
    keep = [c for c in fragments.columns if c not in (*keys, "channel", "seq", "frag", "fragment")]
    group = [*keys, "channel"]
    offsets = running(
        fragments.withColumn("__bucket", F.floor(F.col("seq") / EVENTS_PER_BUCKET)),
        group, "__bucket", ["seq", "frag"],
        sums={"__end": F.octet_length("fragment").cast("bigint")},
    ).withColumn("__start", F.col("__end") - F.octet_length("fragment"))
    own = F.floor(F.col("__start") / block)
    last = F.floor((F.col("__end") + (window - 1)) / block)
    copies = offsets.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(own, last)))
    part = F.struct(
        "__start", "seq", "frag", (F.col("__own") == F.col("__block")).alias("own"), "__end",
        F.decode("fragment", LATIN1).alias("chars"), F.struct(*keep).alias("row") if keep else F.lit(0).alias("row"),
    )
    blocks = copies.groupBy(*group, "__block").agg(F.array_sort(F.collect_list(part)).alias("p"))
    built = blocks.select(
        *group, "p", F.col("p")[0]["__start"].alias("__base"),
        F.encode(F.array_join(F.transform("p", lambda x: x["chars"]), ""), LATIN1).alias("__bytes"),
    )
    mine = F.transform(
        F.filter("p", lambda x: x["own"]),
        lambda x: F.struct(x["__start"].alias("__start"), x["seq"].alias("seq"), x["frag"].alias("frag"),
                           x["__end"].alias("__end"), x["row"].alias("row")),
    )
    rows = built.select(*group, "__base", "__bytes", F.explode(mine).alias("x")).select(
        *group, "__base", "__bytes", "x.*"
    )
    begin = F.greatest(F.lit(0).cast("bigint"), F.col("__start") - window)

    def cut(from_: Column) -> Column:
        return F.substring("__bytes", (from_ - F.col("__base") + 1).cast("int"), (F.col("__end") - from_).cast("int"))

    return rows.select(
        *group, "seq", "frag", *[F.col(f"row.{c}").alias(c) for c in keep],
        cut(F.col("__start")).alias("fragment"), cut(begin).alias("window"),
    )


def fragment_audit(
    fragments: DataFrame, rules: Sequence[rul.Rule], policies: DataFrame,
    window: int = WINDOW_BYTES, rule_version: str = "",
) -> DataFrame:
    """Every fragment's window audited as a response body; windows are never shuffled.

    ``fragments`` carries request_id, tenant_id and path.
    """
    return audit_windows(channel_window(fragments, window=window), rules, policies, rule_version)


def audit_windows(windows: DataFrame, rules: Sequence[rul.Rule], policies: DataFrame,
                  rule_version: str = "") -> DataFrame:
    """The projections of ``fragment_audit``, for batch or streaming windows."""
    matched = with_normal_text(windows, "window", "text").drop("window")
    matched = matched.withColumn("matches", rul.match_list(F.col("text"), rules)).drop("text")
    scored = matched.withColumns(
        {"risk_score": rul.risk_score(F.col("matches")), "rule_version": F.lit(rule_version),
         "direction": F.lit("response")}
    )
    resolved = pol.policy_resolve(scored, policies)
    base = pol.decide(F.col("risk_score"), F.col("policy"))
    return resolved.withColumn("decision", pol.elevate(base, F.col("matches")))


def oversize_cut(events: DataFrame, max_bytes: int = MAX_EVENT_BYTES) -> DataFrame:
    """First event over the size cap per stream."""
    return events.filter(F.octet_length("raw") > max_bytes).groupBy(*stream_keys(events)).agg(
        F.min("seq").alias("cut_seq")
    )


def stream_cut(audited: DataFrame, oversize: DataFrame | None = None) -> DataFrame:
    """Stream key, cut_seq, cut_frag, code of the first event that ends each stream.

    An oversize event ends the stream before its fragments are read, so it wins a tie.
    """
    keys = stream_keys(audited)
    blocked = audited.filter(F.col("decision") == "block").select(
        *keys, "seq", "frag", F.lit(BLOCKED).alias("code")
    )
    if oversize is not None:
        blocked = blocked.unionByName(
            oversize.select(*keys, F.col("cut_seq").alias("seq"), F.lit(-1).alias("frag"),
                            F.lit(TOO_LARGE).alias("code"))
        )
    first = F.min(F.struct("seq", "frag", "code"))
    return blocked.groupBy(*keys).agg(first.alias("f")).select(
        *keys, F.col("f.seq").alias("cut_seq"), F.col("f.frag").alias("cut_frag"), F.col("f.code").alias("code")
    )


def before_cut(rows: DataFrame, cuts: DataFrame, include_trigger: bool) -> DataFrame:
    """Rows up to each stream's cut (events before it; fragments up to the trigger).

    The cut side has one row per ended stream; one long stream's rows spread over tasks.
    """
    joined = salted_lookup(rows, cuts, stream_keys(rows), F.col("seq"))
    inside = F.col("seq") < F.col("cut_seq")
    if include_trigger:
        inside = inside | ((F.col("seq") == F.col("cut_seq")) & (F.col("frag") <= F.col("cut_frag")))
    return joined.filter(F.col("cut_seq").isNull() | inside)


def stream_events(audited: DataFrame, cuts: DataFrame) -> DataFrame:
    """Redacted audit events of the fragments that were audited before each stream ended."""
    kept = before_cut(audited, cuts, True)
    trigger = (F.col("seq") == F.col("cut_seq")) & (F.col("frag") == F.col("cut_frag"))
    metadata = F.create_map(F.lit("sse"), F.lit("true"), F.lit("sse_channel"), F.col("channel"))
    reason = F.create_map(F.lit("stream_termination_reason"), F.col("code"))
    marked = kept.withColumn(
        "metadata", F.when(F.coalesce(trigger, F.lit(False)), F.map_concat(metadata, reason)).otherwise(metadata)
    ).withColumnRenamed("fragment", "body")
    sequence = F.concat_ws("-", "seq", "frag")
    return ev.redact_evidence(ev.to_events(marked, sequence))


def oversize_events(
    transcripts: DataFrame, cuts: DataFrame, policies: DataFrame, rule_version: str = ""
) -> DataFrame:
    """The event of a stream ended by its size: blocked, score 0, empty body."""
    ended = transcripts.drop("body").join(
        cuts.filter(F.col("code") == TOO_LARGE).select(*stream_keys(transcripts), "cut_seq", "code"), stream_keys(transcripts)
    )
    blank = ended.withColumns(
        {
            "direction": F.lit("response"), "body": F.lit(b"").cast("binary"), "risk_score": F.lit(0),
            "matches": F.array().cast(rul.NO_MATCHES), "decision": F.lit("block"),
            "rule_version": F.lit(rule_version),
            "metadata": F.create_map(F.lit("sse"), F.lit("true"), F.lit("stream_termination_reason"), F.col("code")),
        }
    )
    resolved = pol.policy_resolve(blank, policies)
    return ev.to_events(resolved, F.concat(F.col("cut_seq").cast("string"), F.lit("-size")))


def _json_quoted(value: Column) -> Column:
    array = F.to_json(F.array(value))
    return F.substring(array, 2, F.length(array) - 2)


def terminal_event(code: Column, request_id: Column) -> Column:
    message = F.when(code == TOO_LARGE, MESSAGES[TOO_LARGE]).otherwise(MESSAGES[BLOCKED])
    return F.concat(
        F.lit(f'event: {TERMINAL}\ndata: {{"error":{{"type":"security_termination","code":'),
        _json_quoted(code), F.lit(',"message":'), _json_quoted(message),
        F.lit(',"request_id":'), _json_quoted(request_id), F.lit("}}\n\n"),
    )


def delivered_transcript(transcripts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Stream key, request_id, code, delivered bytes: the forwarded prefix plus the terminal event.

    What is forwarded is a byte prefix of the body, so nothing is collected: the length of
    the first ``cut_seq`` events is summed inside the row.
    """
    keys = stream_keys(transcripts)
    joined = transcripts.select(*dict.fromkeys([*keys, "request_id"]), "body").join(cuts, keys, "left")
    length = F.aggregate(
        F.slice(_pieces(F.col("body")), F.lit(1), F.col("cut_seq")), F.lit(0),
        lambda total, piece: total + F.length(piece),
    )
    ended = F.concat(
        F.substring("body", F.lit(1), length), terminal_event(F.col("code"), F.col("request_id")).cast("binary")
    )
    return joined.select(
        *dict.fromkeys([*keys, "request_id"]), "code", F.when(F.col("cut_seq").isNull(), F.col("body")).otherwise(ended).alias("delivered")
    )
