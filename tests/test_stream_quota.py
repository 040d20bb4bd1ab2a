from pyspark.sql import functions as F

from auditlake.streaming import windows
from auditlake.streaming.quota import stream_rate_limit

CALLS = "request_id string, tenant_id string, path string, ts timestamp"


def drained(spark, folder, late, name):
    calls = spark.readStream.schema(CALLS).parquet(f"{folder}/calls")
    limited = stream_rate_limit(calls, 1, 3, 1000, late=late)
    done = (
        limited.writeStream.format("parquet").option("path", f"{folder}/{name}")
        .option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    rows = spark.read.parquet(f"{folder}/{name}").collect()
    return {r.request_id: (r.allowed, r.retry_ms) for r in rows}, done.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_full_buckets_are_forgotten(spark, tmp_path):
    """Batches of calls minutes apart: only the key that is still active is held, the answers stay the same."""
    windows.configure(spark)

    def calls(batch, keys, ms):
        rows = [(f"{batch}-{k}-{i}", k, "/v1/x", ms + 100 * i) for k in keys for i in range(5)]
        frame = spark.createDataFrame(rows, "request_id string, tenant_id string, path string, ms bigint")
        frame.select("request_id", "tenant_id", "path", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")

    answers, held = {}, {}
    for batch, (keys, ms) in enumerate([("abc", 0), ("ab", 1500), ("a", 600_000), ("d", 1_200_000)]):
        calls(batch, keys, ms)
        for name, late in (("kept", None), ("forgotten", "1 second")):
            answers[name], held[name] = drained(spark, tmp_path, late, name)
        assert answers["kept"] == answers["forgotten"]
    # A bucket takes 3 of 5 calls at once, then refills by one token a second.
    assert [answers["kept"][f"0-a-{i}"][0] for i in range(5)] == [True, True, True, False, False]
    assert [answers["kept"][f"1-a-{i}"][0] for i in range(5)].count(True) == 1
    # State, timer and its index: all of them go with the key.
    assert held["kept"] == 4
    assert 0 < held["forgotten"] <= 3
