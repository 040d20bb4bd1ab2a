"""Stream-static audit: rules and policies are read again for every micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.regex import PatternError, to_java
from auditlake.operators.policy import policy_check
from auditlake.operators.rules import MAX_RULES_PER_SET, Rule
from auditlake.plans.audit import audit_events


@dataclass
class Snapshot:
    """The rules and policies last read without a fault."""

    load_rules: Callable[[], tuple[str, Sequence[Rule]]]
    load_policies: Callable[[], DataFrame]
    version: str = ""
    rules: Sequence[Rule] = field(default_factory=list)
    policies: DataFrame | None = None
    stale: bool = True

    def refresh(self) -> None:
        """Read both again; on any fault keep the old ones and mark them stale."""
        try:
            version, rules = self.load_rules()
            if not 1 <= len(rules) <= MAX_RULES_PER_SET:
                raise PatternError("rule count must be 1..1000")
            for rule in rules:
                if rule.regex and rule.pattern:
                    to_java(rule.pattern)
            policies = self.load_policies()
            if policy_check(policies).filter(F.col("errors") != "").limit(1).count():
                raise ValueError("invalid policy")
        except Exception:  # noqa: BLE001 - any fault of a source keeps the last good snapshot
            self.stale = True
            return
        self.version, self.rules, self.policies, self.stale = version, rules, policies, False


def audit_stream(traffic: DataFrame, snapshot: Snapshot, write: Callable[[DataFrame], None], checkpoint: str):
    """Audit a stream of traffic; each batch uses the newest valid snapshot."""

    def each(batch: DataFrame, _: int) -> None:
        snapshot.refresh()
        events = audit_events(batch, snapshot.rules, snapshot.policies, rule_version=snapshot.version)
        write(events.withColumn("stale", F.lit(snapshot.stale)))

    return (
        traffic.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
