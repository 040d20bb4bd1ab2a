import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import negatives
from auditlake.llm.negatives import Block, hard_negatives, spanning_tree

COLUMNS = "vec_id long, embedding array<float>, label int, block string"


def brute(rows, every, most=5, hard=10):
    """The contract, read plainly."""
    sound = {}
    for vec_id, vector, label, _ in rows:
        if vec_id is None or label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        units = [math.floor(256 * float(np.float32(v))) for v in vector]
        sound[vec_id] = min(sound.get(vec_id, (label, units)), (label, units))
    out = []
    for a, (label, units) in sound.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(units, v)), i) for i, (_, v) in sound.items() if i != a)
        near = [(s, i) for s, i in scored if sound[i][0] == label][:most]
        for s, i in near:
            found = [(t, j) for t, j in scored if sound[j][0] != label and 30 * -s <= 100 * -t <= 90 * -s][:hard]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, every, **settings):
    got = hard_negatives(spark.createDataFrame(rows, COLUMNS), F.col("vec_id") % every == 0, **settings)
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, n=400, width=6, spread=0.3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0.4, 0.5) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centre)
        rows.append((i, [float(np.float32(x + rng.gauss(0, spread))) for x in c], rng.randrange(4), "x"))
    same = rows[3][1]
    rows += [(1000 + i, same, i % 2, None) for i in range(60)]  # one common vector, ties by id
    rows += [(2000, None, 1, ""), (2001, [None, 1.0], 1, ""), (2002, [math.nan], 1, ""), (2003, [math.inf], 1, ""), (2004, same, None, "")]
    rows += [(None, same, 1, ""), (2100, [], 1, ""), (2200, [0.5], 2, ""), (2201, [0.5] * (width + 3), 1, ""), (7, rows[7][1], rows[7][2], "x")]
    return rows


@pytest.mark.parametrize("every", [1, 7, 100])
def test_equals_brute_force(spark, every):
    rows = corpus(every)
    assert run(spark, rows, every) == brute(rows, every)


def test_blocks_and_stripes_change_nothing(spark, monkeypatch):
    rows = corpus(5, 300)
    want = brute(rows, 4)
    for block, stripe in ((8, 512), (512, 16), (16, 40)):
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "STRIPE", stripe)
        assert run(spark, rows, 4) == want


def test_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.uniform(0, 5e6))) for _ in range(3)], rng.randrange(3), "") for i in range(120)]
    rows += [(500, [3e30, 1.0, 1.0], 1, "")]  # scores beyond 64 bits: takes no part
    assert run(spark, rows, 10) == brute(rows[:-1], 10)


def test_no_partners(spark):
    assert run(spark, [(100, [1.0], 1, ""), (101, [1.0], 2, "")], 100) == []
    assert run(spark, [(100, [1.0], 1, ""), (101, [1.0], 1, "")], 100) == []
    assert run(spark, [(101, [1.0], 1, "")], 100) == []
    assert run(spark, [], 100) == []


def test_spanning_tree():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (40, 3))
    order, parent, length = spanning_tree(x)
    assert sorted(order.tolist()) == list(range(40))
    place = np.argsort(order)
    assert all(place[parent[k]] < place[k] for k in order[1:].tolist())
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    # Kruskal's total.
    root, total = list(range(40)), 0.0
    for d, i, j in sorted((apart[i, j], i, j) for i in range(40) for j in range(i)):
        if root[i] != root[j]:
            total += d
            root = [root[j] if r == root[i] else r for r in root]
    assert np.isclose(length.sum(), total)


def test_bounds_leave_rows_out():
    """With anchors close together most rows are scored at the root only."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (2000, 8))
    anchors = 150 + rng.integers(-2, 3, (30, 8))
    slot = [{"id": 0, "score": 0, "low": 60_000, "high": 90_000}]
    block = Block(np.arange(30) + 10_000, np.zeros(30, int), anchors, [slot] * 30, False, 10)
    block.meet(np.arange(2000), np.ones(2000, int), rows, np.sqrt((rows**2).sum(1)))
    assert block.scored < 0.25 * 30 * 2000
    score = anchors @ rows.T
    for a in range(30):
        fits = [i for i in np.lexsort((np.arange(2000), -score[a])) if 60_000 <= score[a, i] <= 90_000][:10]
        assert block.held[a][0][0].tolist() == fits
