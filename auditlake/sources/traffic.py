"""Captured traffic and SSE transcripts, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.schemas import TRAFFIC


def traffic_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Traffic table; filters and column choices made on it reach the file scan."""
    return spark.read.schema(TRAFFIC).format(fmt).load(path)


def traffic_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(TRAFFIC).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def sse_source(spark: SparkSession, path: str, glob: str = "*.sse") -> DataFrame:
    """One transcript per file, as bytes: a text source would lose line endings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(F.col("path").alias("capture_id"), name.alias("request_id"), F.col("content").alias("body"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Use every core on an input with fewer splits than cores; otherwise no shuffle is added."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows if splits >= cores else rows.repartition(cores, *keys)
