"""Streaming queries, run over the tables as file streams until nothing is left to read.

Each writes to a new folder below spark.checkpoint.dir and returns what was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import sse
from auditlake.sources.sink import shared_dir
from auditlake.streaming import dedup, quota, refresh, windows
from workload import data, sql
from workload import sse as batch_sse
from workload.metrics import BURST, LIMIT_SQL, PERIOD, RATE
from workload.policy_events import CALLS_SQL

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(function):
        def run(spark, sf_dir):
            windows.configure(data.configure(spark))
            return function(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return register


def drain(rows, name):
    """Run a stream to its end into a new folder and read the folder back."""
    spark = rows.sparkSession
    path = shared_dir(spark, name)
    done = (
        rows.writeStream.format("parquet").option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query("stream_windows", f"WITH {batch_sse.BASE}, {batch_sse.WINDOWS_SQL} SELECT request_id, channel, seq, hex FROM windows")
def stream_windows(spark, sf):
    source = batch_sse.transcripts_of(data.stream(spark, sf, "conversations"))
    fragments = sse.sse_fragments(sse.sse_split(source))
    found = windows.stream_windows(fragments, batch_sse.SMALL_WINDOW)
    return drain(found, "windows").select("request_id", "channel", "seq", F.hex("window").alias("hex"))


@query("stream_until_block", batch_sse.AUDIT_SQL + f""", {batch_sse.CUTS_SQL}
SELECT d.request_id, d.seq, d.decision FROM decided d LEFT JOIN cuts c USING (request_id) WHERE c.cut_seq IS NULL OR d.seq <= c.cut_seq""")
def stream_until_block(spark, sf):
    source = batch_sse.transcripts_of(data.stream(spark, sf, "conversations"))
    fragments = sse.sse_fragments(sse.sse_split(source))

    # Windows are kept by one query; the audit and the cut follow in the next one.
    windowed = windows.stream_windows(fragments)
    path = shared_dir(spark, "until-block")
    done = (
        windowed.writeStream.format("parquet").option("path", f"{path}/windows")
        .option("checkpointLocation", f"{path}/windows-checkpoint").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    stored = spark.readStream.schema(windowed.schema).parquet(f"{path}/windows")
    audited = sse.audit_windows(stored, batch_sse.SSE_RULES, data.policies(spark))
    return drain(windows.stream_until_block(audited), "cut").select("request_id", "seq", "decision")


@query("stream_dedup", "SELECT event_id, epoch_us(ts) AS us FROM events")
def stream_dedup(spark, sf):
    rows = data.stream(spark, sf, "events").select("event_id", F.col("ts").alias("event_time"))
    replay = data.stream(spark, sf, "events").select("event_id", F.col("ts").alias("event_time"))
    once = dedup.stream_dedup(rows.unionByName(replay), "1 hour")
    return drain(once, "dedup").select("event_id", F.unix_micros("event_time").alias("us"))


@query("rules_refresh", sql.AUDIT + f" SELECT request_id, decision, risk_score, '{data.RULE_VERSION}' AS rule_version, false AS stale FROM decided")
def rules_refresh(spark, sf):
    path = shared_dir(spark, "refresh")
    snapshot = refresh.Snapshot(lambda: (data.RULE_VERSION, data.RULES), lambda: data.policies(spark))
    done = refresh.audit_stream(
        data.traffic_of(data.stream(spark, sf, "documents")), snapshot,
        lambda events: events.write.mode("append").parquet(f"{path}/rows"), f"{path}/checkpoint",
    )
    done.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("request_id", "decision", "risk_score", "rule_version", "stale")


@query("stream_rate_limit", LIMIT_SQL + " SELECT event_id, allowed, retry_ms FROM limited")
def stream_rate_limit(spark, sf):
    calls = data.stream(spark, sf, "events").select(
        F.format_string("%020d", "event_id").alias("request_id"), F.concat(F.lit("u"), "user_id").alias("tenant_id"),
        F.col("event_type").alias("path"), "ts",
    )
    rows = drain(quota.stream_rate_limit(calls, RATE, BURST, PERIOD, late="1 day"), "quota")
    return rows.select(F.col("request_id").cast("bigint").alias("event_id"), "allowed", "retry_ms")


@query("stream_windowed_decisions", f"""WITH {CALLS_SQL}
SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, decision, count(*) AS n FROM calls
WHERE time_bucket(INTERVAL 1 DAY, ts) < (SELECT time_bucket(INTERVAL 1 DAY, max(ts) - INTERVAL 1 HOUR) FROM calls) GROUP BY ALL""")
def stream_windowed_decisions(spark, sf):
    from auditlake.operators.windows import windowed_decisions

    rows = windowed_decisions(data.calls_of(data.stream(spark, sf, "events")), "1 day", watermark="1 hour")
    return drain(rows, "decisions").select(F.unix_millis("window_start").alias("start_ms"), "decision", "n")
