"""Running sums and carried values that never put one key's rows into one task.

A plain window over a key sorts all rows of that key in a single task. Here rows are windowed
per (key, bucket) only; one summary row per bucket carries the state across buckets. The
window over the summaries sees (rows of the key / rows per bucket) rows.

A bucket is a coarse function of the order, or, from ``dealt``, a range of about equal row count
whatever the keys and times are. Only a key that goes on in another range needs a carried state,
and a range has two such keys at most: its first and its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.sources.sink import materialize

BUCKET = "__bucket"


def dealt(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows with a column ``__bucket``, edges) for ``running``.

    With a ``bucket`` the rows stay as they are and there are no edges. Without one, Spark samples
    split points of (keys, order) and deals the rows into spark.sql.shuffle.partitions ranges of
    about equal row count. The ranges are written, so their number is data: neither a second
    sampling nor a lost executor can move a row to another range, and each running value reads
    them instead of the input. Rows equal in keys and order share a range.
    """
    if bucket is not None:
        return df.withColumn(BUCKET, bucket), None
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(parts, *keys, *order).withColumn(BUCKET, F.spark_partition_id())
    rows = materialize(ranges, "ranges")
    key = F.struct(*keys)
    ends = rows.groupBy(BUCKET).agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("ends"))
    first_last = ends.select(BUCKET, F.explode("ends").alias("k"))
    seen = first_last.withColumn("n", F.count("*").over(W.partitionBy("k")))
    return rows, seen.filter("n > 1").select("k.*", BUCKET)


def running(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    befores: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Add running values per ``keys`` in ``order``; ``bucket`` must not decrease along it.

    sums     running total, this row included
    lasts    last non-null value up to and including this row
    befores  last non-null value strictly before this row
    nexts    first non-null value strictly after this row
    edges    (keys, bucket) groups with a neighbour in another bucket, from ``dealt``: two a
             bucket at most, so they and their summaries are broadcast and nothing else is summed
    Keys, bucket and order must not be null.
    """
    sums, lasts, befores, nexts = sums or {}, lasts or {}, befores or {}, nexts or {}
    part = keys + [bucket]
    marked = df.withColumns(
        {f"__v_{name}": value for group in (sums, lasts, befores, nexts) for name, value in group.items()}
    )

    def ordered(name: str) -> Column:
        value = F.col(f"__v_{name}")
        return F.when(value.isNotNull(), F.struct(*order, value.alias("v")))

    totals = [F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums]
    totals += [F.max(ordered(n))["v"].alias(f"__t_{n}") for n in [*lasts, *befores]]
    totals += [F.min(ordered(n))["v"].alias(f"__t_{n}") for n in nexts]
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.col(bucket).desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = [F.sum(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in sums]
    carried += [
        F.last(f"__t_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}")
        for n in [*lasts, *befores]
    ]
    carried += [F.last(f"__t_{n}", ignorenulls=True).over(later).alias(f"__c_{n}") for n in nexts]
    summed = marked if edges is None else marked.join(F.broadcast(edges), part, "left_semi")
    carry = summed.groupBy(*part).agg(*totals).select(*part, *carried)
    if edges is not None:
        carry = F.broadcast(carry)

    rows = W.partitionBy(*part).orderBy(*order)
    back = W.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    upto = rows.rowsBetween(W.unboundedPreceding, 0)
    before = rows.rowsBetween(W.unboundedPreceding, -1)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    within = {}
    for n in sums:
        within[n] = F.coalesce(F.sum(f"__v_{n}").over(upto), F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0))
    for frame, names in ((upto, lasts), (before, befores), (after, nexts)):
        for n in names:
            within[n] = F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(frame), F.col(f"__c_{n}"))
    joined = marked.join(carry, part, "left")
    return joined.select(*df.columns, *[value.alias(n) for n, value in within.items()])


def time_bucket(ts: Column, width: str = "1 hour") -> Column:
    """Start of the fixed-width bucket a timestamp falls into."""
    return F.window(ts, width)["start"]
