"""Audit events as topic records (key, value, headers), and back to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.events import redact_evidence
from auditlake.schemas import EVENT, EVENT_COLUMNS

# Fields left out of the record when they are empty.
OPTIONAL_TEXT = ["model", "api_key_id", "policy_id", "auditor_error"]


def _omit_empty(name: str) -> Column:
    value = F.col(name)
    if name in OPTIONAL_TEXT:
        return F.when(value != "", value).alias(name)
    if name == "policy_revision":
        return F.when(value != 0, value).alias(name)
    if name in ("matches", "metadata"):
        return F.when(F.size(value) > 0, value).alias(name)
    return value.alias(name)


def kafka_rows(events: DataFrame) -> DataFrame:
    """key = tenant, value = JSON without empty optional fields, header = event id."""
    safe = redact_evidence(events)
    record = F.struct(*[_omit_empty(c) for c in EVENT_COLUMNS])
    options = {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}
    header = F.struct(F.lit("event_id").alias("key"), F.col("event_id").cast("binary").alias("value"))
    return safe.select(
        F.col("tenant_id").cast("binary").alias("key"),
        F.to_json(record, options).cast("binary").alias("value"),
        F.array(header).alias("headers"),
    )


def write_kafka(events: DataFrame, servers: str, topic: str = "audit.events") -> None:
    """Publish; needs the Kafka connector on the class path. Spark retries make it at least once."""
    kafka_rows(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).option("includeHeaders", "true").save()


def audit_topic_source(records: DataFrame) -> DataFrame:
    """Topic records -> event columns; works on batch and streaming frames alike."""
    return records.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")
