"""API keys: credential checks, inventory, revocations, usage, tenant ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.digest import hmac_sha256
from auditlake.plans.lookup import lookup

# Wire format of a credential and of a tenant id.
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CREDENTIAL = r"\ABearer (agw\.(" + UUID + r")\.[A-Za-z0-9_-]{43})\z"
TENANT_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"


def credential_audit(presented: DataFrame, keys: DataFrame, pepper: bytes, spread: Column,
                     as_of: Column | None = None) -> DataFrame:
    """Classify presented ``authorization`` values; adds outcome, api_key_id, key_tenant_id.

    ``spread`` is any column that differs between presentations of one key.

    malformed, unknown, revoked, mismatch or ok. With ``as_of`` (a timestamp of the
    presented row) a key counts as revoked only from its revocation on.
    """
    whole = F.regexp_extract("authorization", CREDENTIAL, 1)
    key_id = F.lower(F.regexp_extract("authorization", CREDENTIAL, 2))
    # The digest is made before the join, so that the value itself is shuffled only for who asks for it.
    parsed = presented.withColumns({
        "__malformed": whole == "", "__mac": F.when(whole != "", hmac_sha256(whole, pepper)),
        # A malformed value has no id to look up; null keeps it out of the join's hot key.
        "__id": F.when(whole != "", key_id),
    })
    known = keys.select(
        F.lower("id").alias("__id"), F.col("tenant_id").alias("__tenant"), "key_hmac", "revoked_at",
        F.lit(True).alias("__found"),
    )
    joined = lookup(parsed, known, ["__id"], F.coalesce(spread, F.lit(0)))
    revoked = F.col("revoked_at").isNotNull()
    if as_of is not None:
        revoked = revoked & (F.col("revoked_at") <= as_of)
    outcome = (
        F.when(F.col("__malformed"), "malformed")
        .when(F.col("__found").isNull(), "unknown")
        .when(revoked, "revoked")
        .when(F.col("key_hmac") != F.col("__mac"), "mismatch")
        .otherwise("ok")
    )
    checked = joined.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    return checked.select(
        *presented.columns, "outcome", F.when(ok, F.col("__id")).alias("api_key_id"),
        F.when(ok, F.col("__tenant")).alias("key_tenant_id"),
    )


def key_inventory(keys: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Keys newest first; the digest is never selected."""
    shown = keys.select("id", "tenant_id", "prefix", "created_at", "revoked_at")
    if tenant_id is not None:
        shown = shown.filter(F.col("tenant_id") == tenant_id)
    return shown.orderBy(F.col("created_at").desc(), "id")


def key_revocations(log: DataFrame) -> DataFrame:
    """The first revocation of a key stands."""
    return log.groupBy("id").agg(F.min("revoked_at").alias("revoked_at"), F.count("*").alias("attempts"))


def key_usage(keys: DataFrame, events: DataFrame) -> DataFrame:
    """Per key: calls, calls after its revocation, and a state.

    Events meet the keys where they lie (broadcast) or salted, and are then summed before
    they are shuffled by key, so a busy key costs no more than a quiet one.
    """
    used = events.select(F.col("api_key_id").alias("id"), "event_time", "event_id")
    dated = lookup(used, keys.select("id", "revoked_at"), ["id"], F.col("event_id"), "inner")
    totals = dated.groupBy("id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("event_time") >= F.col("revoked_at")).alias("late_calls")
    )
    joined = keys.select("id", "tenant_id", "revoked_at").join(totals, "id", "left")
    calls, late = F.coalesce("calls", F.lit(0)), F.coalesce("late_calls", F.lit(0))
    state = (
        F.when(calls == 0, "unused").when(late > 0, "used_after_revocation")
        .when(F.col("revoked_at").isNotNull(), "revoked").otherwise("active")
    )
    return joined.select("id", "tenant_id", calls.alias("calls"), late.alias("late_calls"), state.alias("state"))


def unknown_key_events(keys: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose key is not in the inventory."""
    return events.join(keys.select(F.col("id").alias("api_key_id")), "api_key_id", "left_anti")


def valid_tenant(tenant: Column) -> Column:
    return tenant.rlike(TENANT_ID)


def tenant_check(table: DataFrame) -> DataFrame:
    """Invalid tenant ids and how many rows carry them."""
    return table.filter(~F.coalesce(valid_tenant(F.col("tenant_id")), F.lit(False))).groupBy("tenant_id").agg(
        F.count("*").alias("n")
    )
