"""The audit plan: traffic -> normalise -> match -> score -> policy -> decision -> events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import require_configured
from auditlake.functions.text import body_bytes, content_sha256, request_model, with_normal_text
from auditlake.operators import events as ev
from auditlake.operators import policy as pol
from auditlake.operators import rules as rul


def audit_text(traffic: DataFrame, rules: Sequence[rul.Rule], rule_version: str = "") -> DataFrame:
    """Adds matches, risk_score and rule_version with one rule set for every row.

    The normalised text is used inside this projection only and is never shuffled.
    """
    require_configured(traffic.sparkSession)
    normal = with_normal_text(traffic)
    matched = normal.withColumn("matches", rul.match_list(F.col("text"), rules)).drop("text")
    return matched.withColumns(
        {"risk_score": rul.risk_score(F.col("matches")), "rule_version": F.lit(rule_version)}
    )


def audit_text_by_tenant(traffic: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """The same with the rule set in force for each row's tenant."""
    require_configured(traffic.sparkSession)
    normal = with_normal_text(traffic)
    matched = rul.match_effective(normal, rul.active_rule_sets(rule_sets)).drop("text")
    return matched.withColumn("risk_score", rul.risk_score(F.col("matches")))


def decide(audited: DataFrame, policies: DataFrame, direction=None) -> DataFrame:
    """Adds the resolved policy and the decision of each audited row."""
    resolved = pol.policy_resolve(audited, policies, direction)
    base = pol.decide(F.col("risk_score"), F.col("policy"))
    return resolved.withColumn("decision", pol.elevate(base, F.col("matches")))


def audit(traffic: DataFrame, rules: Sequence[rul.Rule], policies: DataFrame,
          rule_version: str = "") -> DataFrame:
    """Decisions for requests and whole response bodies, one row per traffic row."""
    return decide(audit_text(traffic, rules, rule_version), policies)


def audit_events(traffic: DataFrame, rules: Sequence[rul.Rule], policies: DataFrame,
                 verdicts: DataFrame | None = None, rule_version: str = "") -> DataFrame:
    """Redacted events of requests; with ``verdicts``, shadow events of allowed ones too."""
    stamped = traffic.withColumns(
        {
            "model": request_model(F.col("body")),
            "body_bytes": body_bytes(F.col("body")),
            "content_sha256": content_sha256(F.col("body")),
        }
    )
    stamped = ev.with_capture_id(stamped)
    # The body ends here: joins below move a row of a few hundred bytes.
    decided = decide(audit_text(stamped, rules, rule_version).drop("body"), policies)
    if verdicts is None:
        return ev.redact_evidence(ev.to_events(decided))
    joined = pol.join_verdicts(decided, verdicts)
    # Both events of a request come from one row, so nothing upstream runs twice.
    events = _with_shadow(joined)
    return ev.redact_evidence(ev.to_events(events, F.col("sequence")))


def _with_shadow(joined: DataFrame) -> DataFrame:
    sequences = F.when(F.col("decision") == "allow", F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    doubled = joined.withColumn("allowed", F.col("decision") == "allow").withColumn(
        "sequence", F.explode(sequences)
    )
    shadow = F.col("allowed") & (F.col("sequence") == 1)
    opinion, error = F.col("__opinion"), F.col("__error")
    checked = pol.verdict_decisions(doubled.withColumns({"__o": opinion, "__e": error}))
    return checked.withColumns(
        {
            "auditor": F.when(shadow, F.col("__o")).otherwise(F.col("auditor")),
            "auditor_error": F.when(shadow & F.col("__o").isNull(), F.col("__e")).otherwise(
                F.col("auditor_error")
            ),
        }
    ).drop("__o", "__e", "allowed")


def audit_responses(traffic: DataFrame, rules: Sequence[rul.Rule], policies: DataFrame,
                    max_bytes: int = ev.MAX_RESPONSE_BYTES, rule_version: str = "") -> DataFrame:
    """Whole response bodies, each audited; ``too_large`` tells which are over ``max_bytes``."""
    sized = ev.with_capture_id(traffic).withColumn("too_large", F.octet_length("body") > max_bytes)
    return audit(sized, rules, policies, rule_version)


def response_events(traffic: DataFrame, rules: Sequence[rul.Rule], policies: DataFrame, verdicts: DataFrame | None = None,
                    max_bytes: int = ev.MAX_RESPONSE_BYTES, rule_version: str = "") -> DataFrame:
    """Redacted events of response bodies; with ``verdicts``, shadow events of allowed ones too."""
    stamped = traffic.withColumns({"body_bytes": body_bytes(F.col("body")), "content_sha256": content_sha256(F.col("body"))})
    decided = audit_responses(stamped, rules, policies, max_bytes, rule_version).drop("body")
    size = F.create_map(F.lit("too_large"), F.lit("true"))
    decided = decided.withColumn("metadata", F.when(F.col("too_large"), size)).drop("too_large")
    if verdicts is None:
        return ev.redact_evidence(ev.to_events(decided))
    doubled = _with_shadow(pol.join_verdicts(decided, verdicts))
    return ev.redact_evidence(ev.to_events(doubled, F.col("sequence")))
