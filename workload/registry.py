"""All queries and their SQL, by name."""

from workload import metrics, policy_events, sse, stream, text_rules

QUERIES, ORACLE = {}, {}
for module in (text_rules, policy_events, sse, metrics, stream):
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)
