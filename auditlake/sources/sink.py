"""Append-only event table, one row per event_id however often a batch runs, whatever its time."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.events import new_events, redact_evidence
from auditlake.schemas import EVENT


@functools.cache
def _local_dir() -> str:
    """One machine only: any folder is shared."""
    return tempfile.mkdtemp(prefix="auditlake-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = _local_dir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{base.rstrip('/')}/auditlake/{name}-{uuid.uuid4().hex}"


def materialize(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder and read back.

    For results with several readers whose computation costs more than the write. The files
    outlive any executor; the folder is the cluster's to clean up.
    """
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored events with their partition columns; None if nothing was stored yet."""
    try:
        return spark.read.schema(f"{EVENT}, event_bucket string, event_date date").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def audit_sink(batch: DataFrame, path: str) -> None:
    """Append the events of a batch that are not stored yet.

    An event is known by its id alone: a replay with another time, or none, is not stored again.
    The table is partitioned by the first digit of the id, so that ids are looked up in the buckets
    the batch touches, and by day for readers. Only the id column is read back. Meant for one writer
    at a time, like a micro-batch stream.
    """
    spark = batch.sparkSession
    rows = redact_evidence(batch).withColumns(
        {"event_bucket": F.substring("event_id", 1, 1), "event_date": F.to_date("event_time")}
    )
    stored = read_events(spark, path)
    if stored is not None:
        buckets = rows.select("event_bucket").distinct()
        ids = stored.select("event_id", "event_bucket").join(F.broadcast(buckets), "event_bucket", "left_semi")
        rows = new_events(rows, ids)
    else:
        rows = rows.dropDuplicates(["event_id"])
    # Partitions of even size, so that a busy day is written by many tasks and a quiet one by few.
    layout = ["event_bucket", "event_date"]
    spread = rows.hint("rebalance", *layout).sortWithinPartitions(*layout, "tenant_id")
    spread.write.mode("append").partitionBy(*layout).parquet(path)


def stream_to_sink(events: DataFrame, path: str, checkpoint: str):
    """Write a stream of events with the same idempotent batch function."""
    return (
        events.writeStream.foreachBatch(lambda batch, _: audit_sink(batch, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
