from auditlake.operators.rules import Rule
from auditlake.schemas import POLICY_FIELDS
from auditlake.streaming.refresh import Snapshot


def test_bad_rules_keep_the_old_snapshot(spark):
    good = spark.createDataFrame([("p", "global", "*", "request", 30, 80, "block", "fail_open", 1)], POLICY_FIELDS)
    bad = spark.createDataFrame([("p", "team", "*", "request", 30, 80, "block", "fail_open", 1)], POLICY_FIELDS)
    state = {"rules": ("v1", [Rule("a", "", "x")]), "policies": good}
    snapshot = Snapshot(lambda: state["rules"], lambda: state["policies"])
    snapshot.refresh()
    assert (snapshot.version, snapshot.stale) == ("v1", False)
    state["rules"] = ("v2", [Rule("b", "", "[", regex=True)])
    snapshot.refresh()
    assert (snapshot.version, snapshot.stale) == ("v1", True)
    state.update(rules=("v3", [Rule("c", "", "y")]), policies=bad)
    snapshot.refresh()
    assert (snapshot.version, snapshot.stale) == ("v1", True)
    state["policies"] = good
    snapshot.refresh()
    assert (snapshot.version, snapshot.stale) == ("v3", False)
