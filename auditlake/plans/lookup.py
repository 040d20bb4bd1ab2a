"""Joins of many rows to one row per key, safe when one key holds much of the many side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20
SALTS = 32
#: Keys are counted in so many hash groups; at most MAX_BUSY of them are busy.
GROUPS = 4096
MAX_BUSY = 256
#: Types whose equal values have one hash.
HASHED_ALIKE = {"string", "bigint", "int", "smallint", "tinyint", "date", "timestamp", "binary"}


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as JSON; one aggregate over ``df``."""
    row = F.octet_length(F.to_json(F.struct(*df.columns))).cast("long")
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]


def _group(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(GROUPS))


def busy_groups(rows: DataFrame, keys: list[str]) -> list[int]:
    """Hash groups of keys that hold more than 1 / MAX_BUSY of the rows; null keys are a group too.

    One aggregate over the keys of all ``rows``, which shuffles a count per group and task.
    """
    counts = {r["g"]: r["n"] for r in rows.groupBy(_group(keys).alias("g")).agg(F.count("*").alias("n")).collect()}
    return sorted(g for g, n in counts.items() if n * MAX_BUSY > sum(counts.values()))


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "left",
                  salts: int = SALTS, busy: list[int] | None = None) -> DataFrame:
    """Equi join whose hot keys are spread over ``salts`` tasks.

    Every table row is repeated per salt and ``spread``, a stable value of the row, picks
    one copy, so the result is the same whenever a task is run again. With ``busy``, from
    ``busy_groups``, only keys of these groups are repeated and spread.
    """
    salt, last = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"), F.lit(salts - 1)
    if busy is not None:
        hot = _group(keys).isin(busy)
        salt, last = F.when(hot, salt).otherwise(0), F.when(hot, last).otherwise(0)
    salted = rows.withColumn("__salt", salt)
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "left",
           max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``table`` if it measures at most ``max_bytes``; else a join that salts busy keys.

    ``table`` is read once to measure it and, if it is larger, the keys of ``rows`` once to count
    them, so both should be stored tables or cheap to derive. A stream's keys can't be counted, nor
    are keys of two types hashed alike: there all keys are salted.
    """
    if measured_bytes(table) <= max_bytes:
        return rows.join(F.broadcast(table), keys, how)
    kinds = [[dict(side.dtypes)[k] for k in keys] for side in (rows, table)]
    counted = not rows.isStreaming and kinds[0] == kinds[1] and set(kinds[0]) <= HASHED_ALIKE
    return salted_lookup(rows, table, keys, spread, how, busy=busy_groups(rows, keys) if counted else None)
