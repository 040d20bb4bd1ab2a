import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.llm.mixing import capped_targets, flow, key, mix

WORD = r"[^\x20\x09-\x0D]+"


def test_targets():
    sizes, weights = {"a": 100, "b": 1000, None: 10}, {"a": 3, "b": 1, None: 2}
    got = capped_targets(sizes, weights, 1.5 * 1110, 2)
    assert got == {"a": 200.0, "b": 1665 - 220, None: 20.0}
    assert capped_targets({"a": 0}, {"a": 1}, 0, 2) == {"a": 0.0}


def test_flow_prefers_first_copies_and_reroutes():
    # "b" can only use the shared documents, so "a" has to leave them although it comes first.
    got = flow({("a",): 10, ("a", "b"): 10}, {"a": 10, "b": 10})
    assert got == {(("a",), "a", 0): 10.0, (("a", "b"), "b", 0): 10.0}
    twice = flow({("a",): 10}, {"a": 15})
    assert twice == {(("a",), "a", 0): 10.0, (("a",), "a", 1): 5.0}


def test_flow_is_cheapest():
    """Against all integer flows of a small network."""
    rng = random.Random(5)
    for _ in range(20):
        supply = {("a",): rng.randrange(4), ("b",): rng.randrange(4), ("a", "b"): rng.randrange(1, 4)}
        quotas = {"a": rng.randrange(6), "b": rng.randrange(6)}
        got = flow(supply, quotas)
        best = max(
            (min(x, quotas["a"]) + min(y, quotas["b"]) if x <= quotas["a"] and y <= quotas["b"] else -1,
             -sum(max(0, used - supply[p]) for p, used in ((("a",), a), (("b",), b), (("a", "b"), c + d))))
            for a in range(2 * supply[("a",)] + 1) for b in range(2 * supply[("b",)] + 1)
            for c in range(2 * supply[("a", "b")] + 1) for d in range(2 * supply[("a", "b")] + 1 - c)
            for x, y in [(a + c, b + d)]
        )
        assert abs(sum(got.values()) - best[0]) < 1e-6
        assert abs(-sum(w for (_, _, k), w in got.items() if k) - best[1]) < 1e-6


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "x " * 3000, "a"), (7, rows[7][1], rows[7][2]), (None, "one two", "c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mix(docs, [3, 1, 2]).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(re.findall(WORD, text or ""))
    targets = capped_targets(size, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(size.values()), 2)
    for source in size:
        mine = [r for r in got if r.pattern == key((source,))]
        assert {r.source_size for r in mine} == {size[source]}
        assert abs(sum(r["size"] * r.copies for r in mine) - targets[source]) <= 3
        assert {round(r.target, 6) for r in mine} == {round(targets[source], 6)}
        assert all(0 <= r.copies <= 2 for r in mine)
    again = mix(docs.repartition(7), [3, 1, 2]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(docs.limit(0), [3, 1, 2]).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i < 50 else ["b", "a"]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    got = mix(docs, [1, 1], share=0.9, sources=F.col("tags")).collect()
    assert sum(r["size"] * r.copies for r in got) == pytest.approx(900, abs=10)
    assert {r.copies for r in got} == {0, 1}


def test_a_large_document_leaves_no_gap(spark):
    """Second copies of small documents fill what one very large document cannot."""
    rows = [(i, "w " * 10, "a") for i in range(40)] + [(100, "w " * 500, "a")] + [(200 + i, "w " * 10, "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(4):
        got = mix(docs, [1, 9], share=1.1, seed=seed).collect()
        for source in "ab":
            mine = [r for r in got if r.pattern == key((source,))]
            taken, target = sum(r["size"] * r.copies for r in mine), mine[0].target
            assert abs(taken - target) <= 10 and all(0 <= r.copies <= 2 for r in mine)
