"""Policies: defaults, checks, resolution by tenant and route, decisions, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import KNOWN_ROUTES
from auditlake.plans.lookup import lookup
from auditlake.plans.segmented import BUCKET, dealt, running

# The lattice of decisions, and the defaults of an unset policy field.
RANK = {"allow": 0, "monitor": 1, "redact": 2, "block": 3}
DEFAULTS = {
    "scope": "global", "route_path": "*", "direction": "request", "monitor_at": 30,
    "intervention_at": 80, "intervention_action": "block", "auditor_failure_mode": "fail_open",
    "revision": 1,
}
_TYPES = {"monitor_at": "int", "intervention_at": "int", "revision": "bigint"}
POLICY_COLUMNS = ["id", *DEFAULTS]


def _default_of(name: str, value: Column) -> Column:
    kind = _TYPES.get(name, "string")
    unset = F.coalesce(value, F.lit(0)) <= 0 if kind != "string" else F.coalesce(value, F.lit("")) == ""
    return F.when(unset, F.lit(DEFAULTS[name])).otherwise(value).cast(kind)


def policy_defaults(policies: DataFrame) -> DataFrame:
    return policies.withColumns({n: _default_of(n, F.col(n)) for n in DEFAULTS})


def policy_check(policies: DataFrame) -> DataFrame:
    """Adds ``errors``: names of the rules the (defaulted) policy breaks, comma separated."""
    c = F.col
    tenant_scope = c("scope").startswith("tenant:") & (F.length("scope") > len("tenant:"))
    broken = {
        "scope": ~((c("scope") == "global") | tenant_scope),
        "route_path": ~c("route_path").isin(["*", *KNOWN_ROUTES]),
        "direction": ~c("direction").isin("request", "response"),
        "thresholds": (c("monitor_at") < 1) | (c("intervention_at") > 100)
        | (c("monitor_at") >= c("intervention_at")),
        "intervention_action": ~c("intervention_action").isin("block", "redact"),
        "auditor_failure_mode": ~c("auditor_failure_mode").isin("fail_open", "fail_closed"),
    }
    errors = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in broken.items()]))
    return policy_defaults(policies).withColumn("errors", F.array_join(errors, ","))


def _fallback() -> Column:
    values = {"id": "", **DEFAULTS}
    return F.struct(*[F.lit(values[n]).cast(_TYPES.get(n, "string")).alias(n) for n in POLICY_COLUMNS])


def _by_scope(policies: DataFrame) -> DataFrame:
    """One row per scope holding map 'route|direction' -> policy.

    Policies are unique per (scope, route, direction) and there are five routes and two
    directions, so a map has at most ten entries; duplicates keep the lowest id.
    """
    known = policies.filter(
        F.col("route_path").isin(["*", *KNOWN_ROUTES]) & F.col("direction").isin("request", "response")
    )
    policy = F.struct(*[F.col(n).cast(_TYPES.get(n, "string")).alias(n) for n in POLICY_COLUMNS])
    unique = known.groupBy("scope", "route_path", "direction").agg(F.min_by(policy, F.col("id")).alias("p"))
    entry = F.struct(F.concat_ws("|", "route_path", "direction").alias("k"), F.col("p").alias("v"))
    return unique.groupBy("scope").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))


def policy_resolve(traffic: DataFrame, policies: DataFrame, direction: Column | None = None) -> DataFrame:
    """Adds struct ``policy``: tenant+route, tenant+*, global+route, global+*, built-in default.

    The global scope is one value of at most ten policies, read as a scalar subquery; the
    tenant side is broadcast if its measured size allows and salted otherwise.
    """
    direction = F.col("direction") if direction is None else direction
    scopes = _by_scope(policy_defaults(policies))
    tenant = scopes.filter(F.col("scope").startswith("tenant:")).select(
        F.expr("substring(scope, 8)").alias("tenant_id"), F.col("m").alias("__tenant")
    )
    everyone = scopes.filter(F.col("scope") == "global").agg(F.first("m")).scalar()
    joined = lookup(traffic, tenant, ["tenant_id"], F.col("request_id")).withColumn("__global", everyone)
    exact, any_route = F.concat_ws("|", "path", direction), F.concat_ws("|", F.lit("*"), direction)
    # Unknown paths only match '*', as no policy can name them.
    found = F.coalesce(
        F.try_element_at("__tenant", exact), F.try_element_at("__tenant", any_route),
        F.try_element_at("__global", exact), F.try_element_at("__global", any_route), _fallback(),
    )
    return joined.select(*traffic.columns, found.alias("policy"))


def decide(score: Column, policy: Column) -> Column:
    return (
        F.when(score >= policy["intervention_at"], policy["intervention_action"])
        .when(score >= policy["monitor_at"], "monitor")
        .otherwise("allow")
    )


def rank(decision: Column) -> Column:
    chain = F
    for name, value in RANK.items():
        chain = chain.when(decision == name, value)
    return chain.otherwise(-1)


def elevate(decision: Column, matches: Column) -> Column:
    """Raise the decision to the strongest matched rule action; never lower it."""
    strongest = F.coalesce(F.array_max(F.transform(matches, lambda m: rank(m["action"]))), F.lit(-1))
    final = F.greatest(rank(decision), strongest)
    return F.element_at(F.array(*[F.lit(n) for n in RANK]), final + 1)


VERDICT_COLUMNS = ["verdict", "risk_score", "confidence", "categories", "evidence", "model", "version"]


def join_verdicts(audited: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attach second opinions (struct ``verdict``) and their error.

    Opinions are found by capture_id where they carry one, else by tenant_id and request_id or by
    request_id alone, as far as they have these columns. Of several opinions on one request the
    first counts, by ``at`` where there is such a column. A request without a row counts as a failed call, like an unreachable second opinion.
    """
    given = [k for k in ("capture_id", "tenant_id", "request_id") if k in verdicts.columns]
    keys = ["capture_id"] if "capture_id" in given and "capture_id" in audited.columns else [k for k in given if k != "capture_id"]
    columns = [*VERDICT_COLUMNS, "error"]
    first = F.min_by(F.struct(*columns), F.struct(*(["at"] if "at" in verdicts.columns else []), F.to_json(F.struct(*columns))))
    one = verdicts.groupBy(*keys).agg(first.alias("v")).select(*keys, "v.*")
    known = one.select(
        *keys,
        F.when(F.coalesce("error", F.lit("")) == "", F.struct(*VERDICT_COLUMNS)).alias("__opinion"),
        F.coalesce("error", F.lit("")).alias("__error"),
    )
    joined = audited.join(known, keys, "left")
    missing = F.when(F.col("__opinion").isNull(), F.lit("auditor unavailable")).otherwise("")
    error = F.when(F.col("__error") != "", F.col("__error")).otherwise(missing)
    return joined.withColumn("__error", error)


def verdict_decisions(joined: DataFrame) -> DataFrame:
    """Promote monitored requests by their second opinion.

    Only 'monitor' asks for one. A blocking or high-scoring opinion blocks, whatever the
    policy's own action; a failed call blocks under fail_closed and is kept as is otherwise.
    """
    asked = F.col("decision") == "monitor"
    opinion, policy = F.col("__opinion"), F.col("policy")
    failed = asked & opinion.isNull()
    blocks = opinion.isNotNull() & (
        (opinion["verdict"] == "block") | (opinion["risk_score"] >= policy["intervention_at"])
    )
    fail_closed = opinion.isNull() & (policy["auditor_failure_mode"] == "fail_closed")
    return joined.withColumns(
        {
            "auditor": F.when(asked, opinion),
            "auditor_error": F.when(failed, F.col("__error")).otherwise(""),
            "decision": F.when(asked & (F.coalesce(blocks, F.lit(False)) | fail_closed), "block")
            .otherwise(F.col("decision")),
        }
    ).drop("__opinion", "__error")


def shadow_verdicts(joined: DataFrame) -> DataFrame:
    """Second event of allowed texts: same decision, with the opinion or its error."""
    return joined.filter(F.col("decision") == "allow").withColumns(
        {
            "auditor": F.col("__opinion"),
            "auditor_error": F.when(F.col("__opinion").isNull(), F.col("__error")).otherwise(""),
        }
    ).drop("__opinion", "__error")


def is_shadow(events: DataFrame) -> Column:
    """Marks shadow events, to leave out when counting requests."""
    return (F.col("decision") == "allow") & (
        F.col("auditor").isNotNull() | (F.coalesce("auditor_error", F.lit("")) != "")
    )


def policy_coverage(rule_sets: DataFrame, policies: DataFrame) -> DataFrame:
    """One row: are a managed global rule set and both global policies in place?"""
    managed = (F.col("scope") == "global") & (F.col("status") == "published") & (F.col("source") == "managed")
    scoped = policies.filter(F.col("scope") == "global").agg(
        F.struct(
            F.count_if(F.col("direction") == "request").alias("request_policies"),
            F.count_if(F.col("direction") == "response").alias("response_policies"),
        )
    )
    counted = rule_sets.agg(F.count_if(managed).alias("managed_rule_sets")).withColumn("__p", scoped.scalar())
    ok = (F.col("managed_rule_sets") > 0) & (F.col("request_policies") > 0) & (F.col("response_policies") > 0)
    return counted.select("managed_rule_sets", "__p.*").withColumn("covered", ok)


def policy_timeline(changes: DataFrame, keys: list[str], order: list[str],
                    bucket: Column | None = None) -> DataFrame:
    """Revision number of each change of a policy (1, 2, ...), in change order.

    Counted in ranges of even size, or in a ``bucket`` of the order where none is busy.
    """
    rows, edges = dealt(changes, keys, order, bucket)
    return running(
        rows, keys, BUCKET, order, sums={"revision": F.lit(1).cast("bigint")}, edges=edges,
    ).drop(BUCKET)


def snapshot_hash(table: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a whole table, independent of row order.

    Row digests are folded per 3-hex-digit bucket, then the 4096 bucket digests are folded,
    so neither step holds the table in one place.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    row = F.sha2(F.concat_ws("\x1f", *parts), 256)
    rows = table.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    buckets = rows.groupBy(F.substring("h", 1, 3).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", "n"))), ","), 256).alias("d"),
        F.sum("n").alias("n"),
    )
    return buckets.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "d"))), ","), 256).alias("hash"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )
