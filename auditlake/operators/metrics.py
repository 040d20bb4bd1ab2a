"""Counters, histograms, samples, alerts, readiness, backlog and outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.segmented import BUCKET, dealt, running

# Upper bounds of the latency histogram, in seconds, as they are printed.
LATENCY_BUCKETS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2", "5"]

# How long each alert condition has to hold, in seconds.
ALERTS = {
    "not_ready": 120, "dependency_down": 60, "queue_near_capacity": 300, "outbox_backlog": 600,
    "limiter_fallback": 300, "auditor_down": 300,
}
OUTAGE_FAILURES = 5
OUTAGE_SECONDS = 30
CIRCUIT_OPEN = "auditor circuit open"


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def latency_histogram(observations: DataFrame, seconds: str, *labels: str) -> DataFrame:
    """Cumulative bucket counts (le), sum and count per label set, one row per bucket."""
    value = F.col(seconds)
    sums = [F.count_if(value <= float(b)).alias(f"b{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    wide = observations.groupBy(*labels).agg(*sums, F.count("*").alias("n"), F.sum(value).alias("total"))
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(LATENCY_BUCKETS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("count")))
    return wide.select(*labels, F.explode(F.array(*rows)).alias("b"), "total", "n").select(
        *labels, "b.le", F.col("b.count").alias("bucket_count"), F.col("total").alias("sum"), F.col("n").alias("count")
    )


def _labels(labels: tuple[str, ...]) -> Column:
    pairs = [part for name in labels for part in (F.lit(name), F.col(name).cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def counter_samples(name: str, counted: DataFrame, *labels: str) -> DataFrame:
    return counted.select(F.lit(name).alias("name"), _labels(labels).alias("labels"),
                          F.col("n").cast("double").alias("value"))


def gauge_samples(name: str, gauges: DataFrame, value: str, *labels: str) -> DataFrame:
    return gauges.select(F.lit(name).alias("name"), _labels(labels).alias("labels"),
                         F.col(value).cast("double").alias("value"))


def histogram_samples(name: str, histogram: DataFrame, *labels: str) -> DataFrame:
    """Bucket, sum and count rows of a histogram, without reading it three times."""
    base = _labels(labels)
    bucket = F.struct(
        F.lit(f"{name}_bucket").alias("name"),
        F.map_concat(base, F.create_map(F.lit("le"), F.col("le"))).alias("labels"),
        F.col("bucket_count").cast("double").alias("value"),
    )
    totals = [
        F.struct(F.lit(f"{name}_{part}").alias("name"), base.alias("labels"), F.col(part).cast("double").alias("value"))
        for part in ("sum", "count")
    ]
    rows = F.when(F.col("le") == "+Inf", F.array(bucket, *totals)).otherwise(F.array(bucket))
    return histogram.select(F.explode(rows).alias("s")).select("s.*")


def metric_samples(*frames: DataFrame) -> DataFrame:
    """One long table (name, labels, value), ordered by name and labels."""
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame)
    return table.orderBy("name", F.array_sort(F.map_entries("labels")))


def exact_percentile(rows: DataFrame, value: str, p: float, bin_width: float) -> DataFrame:
    """One row ``percentile``: linear interpolation between the two closest ranks.

    Equal values collapse before the shuffle. Ranks are running counts over bins of
    ``bin_width``, so no task ever holds all distinct values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    binned = counted.withColumns({"__all": F.lit(0), "__bin": F.floor(F.col("v") / bin_width)})
    ranked = running(binned, ["__all"], "__bin", ["v"], sums={"upto": F.col("c")})
    total = counted.agg(F.sum("c")).scalar()
    position = (total - 1) * F.lit(p)
    below = F.col("upto") - F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((below <= rank) & (rank < F.col("upto")), F.col("v")))

    low, high = F.floor(F.col("__pos")), F.ceil(F.col("__pos"))
    # One partial maximum per task, then one row.
    picked = ranked.withColumn("__pos", position).agg(
        at(low).alias("lo"), at(high).alias("hi"), F.max("__pos").alias("pos")
    )
    share = F.col("pos") - F.floor("pos")
    return picked.select((F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("percentile"))


def dashboard(requests: DataFrame, decision: str, latency: str, bin_width: float = 0.001) -> DataFrame:
    """Requests, blocked requests and the exact 95th percentile of latency."""
    counts = requests.agg(
        F.count("*").alias("requests"), F.count_if(F.col(decision) == "block").alias("blocked")
    )
    p95 = exact_percentile(requests, latency, 0.95, bin_width)
    return counts.withColumn("p95", p95.scalar())


def dashboard_approx(requests: DataFrame, decision: str, latency: str, accuracy: int = 10_000) -> DataFrame:
    """The same in one pass, with a bounded rank error."""
    return requests.agg(
        F.count("*").alias("requests"), F.count_if(F.col(decision) == "block").alias("blocked"),
        F.percentile_approx(latency, 0.95, accuracy).alias("p95"),
    )


def decision_rollup(events: DataFrame, *labels: str) -> DataFrame:
    """Decision counts with subtotals for every prefix of the labels."""
    return events.rollup(*labels, "decision").agg(
        F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")
    )


def top_rules(hits: DataFrame, n: int) -> DataFrame:
    """Most-hit rules with the number of tenants they hit (counted in two steps)."""
    per_tenant = hits.groupBy("rule_id", "tenant_id").agg(F.count("*").alias("c"))
    per_rule = per_tenant.groupBy("rule_id").agg(F.sum("c").alias("hits"), F.count("*").alias("tenants"))
    return per_rule.orderBy(F.col("hits").desc(), "rule_id").limit(n)


def alert_for(samples: DataFrame, holds_for: Column, bucket: Column | None = None) -> DataFrame:
    """(series, ts, seq, firing) samples -> islands where the condition held long enough.

    An island is a run of samples with no false sample between them, named by the last
    false one before it; it fires when it spans ``holds_for`` seconds or more. Samples are
    followed in ranges of even size, or in a ``bucket`` of ts where no series is busy.
    """
    rows, edges = dealt(samples, ["series"], ["ts", "seq"], bucket)
    marked = running(
        rows, ["series"], BUCKET, ["ts", "seq"],
        lasts={"__since": F.when(~F.col("firing"), F.struct("ts", "seq"))}, edges=edges,
    )
    islands = marked.filter("firing").groupBy("series", "__since").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("samples")
    ).drop("__since")
    held = F.unix_micros("ended") - F.unix_micros("started")
    return islands.filter(held >= holds_for * 1_000_000)


def readiness_rollup(probes: DataFrame) -> DataFrame:
    """Latest status per component -> one row: ready unless a required one is not ok."""
    latest = probes.groupBy("component").agg(
        F.max_by(F.struct("required", "status"), F.struct("checked_at", "seq")).alias("p")
    )
    bad = F.col("p.required") & (F.col("p.status") != "ok")
    return latest.agg(
        F.when(F.count_if(bad) > 0, "not_ready").otherwise("ready").alias("status"),
        F.count("*").alias("components"), F.count_if(bad).alias("failing"),
    )


def outbox_pending(outbox: DataFrame) -> DataFrame:
    return outbox.filter(F.col("published_at").isNull()).agg(F.count("*").alias("pending"))


def outbox_claimable(outbox: DataFrame, now: Column, n: int = 100) -> DataFrame:
    """The oldest unpublished rows that are due and not leased."""
    due = F.col("published_at").isNull() & (F.col("available_at") <= now)
    free = F.col("lease_until").isNull() | (F.col("lease_until") < now)
    return outbox.filter(due & free).orderBy("created_at", "event_id").limit(n)


def auditor_outages(calls: DataFrame, bucket: Column | None = None, failures: int = OUTAGE_FAILURES,
                    seconds: int = OUTAGE_SECONDS) -> DataFrame:
    """(auditor, ts, seq, error) calls -> outages: every 5th consecutive failure opens one.

    A success ends a run; calls refused while an outage is open are not failures. Calls are
    counted in ranges of even size, or in a ``bucket`` of ts where no auditor is busy.
    """
    asked = calls.filter(F.coalesce("error", F.lit("")) != CIRCUIT_OPEN)
    real, edges = dealt(asked, ["auditor"], ["ts", "seq"], bucket)
    failed = F.coalesce("error", F.lit("")) != ""
    counted = running(
        real, ["auditor"], BUCKET, ["ts", "seq"], sums={"__failures": failed.cast("bigint")}, edges=edges
    )
    # Failures up to the latest success, subtracted to get the position inside the run.
    based = running(
        counted, ["auditor"], BUCKET, ["ts", "seq"],
        lasts={"__base": F.when(~failed, F.col("__failures"))}, edges=edges,
    )
    position = F.col("__failures") - F.coalesce("__base", F.lit(0))
    opened = based.filter(failed & (position % failures == 0))
    return opened.select(
        "auditor", F.col("ts").alias("opened_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("open_until"),
        (position / failures).cast("int").alias("nth_in_run"),
    )
