"""Rules and policies from JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.schemas import CONFIG


def parse_config(documents: DataFrame, column: str) -> DataFrame:
    """JSON text column -> struct ``config`` {rules[], policies[]}; null when malformed."""
    return documents.withColumn("config", F.from_json(column, CONFIG))


def load_config(spark: SparkSession, path: str) -> DataFrame:
    return parse_config(spark.read.text(path, wholetext=True), "value")


def config_rules(configs: DataFrame, *keep: str) -> DataFrame:
    """One row per rule; ``position`` identifies it (ids may repeat)."""
    return configs.select(*keep, F.posexplode("config.rules").alias("position", "r")).select(
        *keep, "position", "r.*"
    )


def config_policies(configs: DataFrame, *keep: str) -> DataFrame:
    return configs.select(*keep, F.explode("config.policies").alias("p")).select(*keep, "p.*")
