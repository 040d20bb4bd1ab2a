"""Histories of rule sets and policies: validity intervals and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.segmented import BUCKET, dealt, running


def rule_set_timeline(changes: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(scope, ts, version) publications -> (scope, version, valid_from, valid_to).

    A publication replaces the scope's current set; a rollback is the publication of an
    older version. Of publications at the same instant the highest version stands. Rows are
    sorted in ranges of even size; a ``bucket``, a coarse function of ts, saves writing them
    where no scope is busy within one.
    """
    one = changes.groupBy("scope", "ts").agg(F.max("version").alias("version"))
    dated, edges = dealt(one, ["scope"], ["ts"], bucket)
    ended = running(dated, ["scope"], BUCKET, ["ts"], nexts={"valid_to": F.col("ts")}, edges=edges)
    return ended.select("scope", "version", F.col("ts").alias("valid_from"), "valid_to")


def rules_asof(probes: DataFrame, changes: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Adds ``rule_version``: the version in force in the probe's scope at its ts.

    Publications and probes are merged in time order and the last version is carried
    forward, so no range join is needed and neither side has to be small. A publication at
    the very instant of a probe is in force for it. Probes of one scope and instant are told
    apart by a digest of their columns, so that many of them still fill several ranges.
    """
    one = changes.groupBy("scope", "ts").agg(F.max("version").alias("version"))
    blank = [c for c in probes.columns if c not in ("scope", "ts")]
    types = dict(probes.dtypes)
    hashed = [c for c in blank if "map<" not in types[c] and "variant" not in types[c]]
    tie = F.xxhash64(*hashed) if hashed else F.lit(0).cast("bigint")
    marks = one.select(
        "scope", "ts", F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__tie"), "version",
        *[F.lit(None).cast(types[c]).alias(c) for c in blank],
    )
    asked = probes.select(
        "scope", "ts", F.lit(1).alias("__kind"), tie.alias("__tie"),
        F.lit(None).cast(dict(one.dtypes)["version"]).alias("version"), *blank,
    )
    order = ["ts", "__kind", "__tie"]
    merged, edges = dealt(marks.unionByName(asked), ["scope"], order, bucket)
    carried = running(merged, ["scope"], BUCKET, order, lasts={"rule_version": F.col("version")}, edges=edges)
    return carried.filter(F.col("__kind") == 1).select(*probes.columns, "rule_version")
