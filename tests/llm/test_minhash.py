import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import minhash
from auditlake.llm.components import components
from auditlake.llm.minhash import least_agreements, near_duplicates, shingles, signatures, smallest_reached
from auditlake.llm.texts import text_bytes

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, threshold):
    sets = {d: brute_set(t) for d, t in rows if d is not None}
    low = {d: d for d in sets}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                low[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def variants(rng, copies):
    base = [f"W{rng.randrange(5000)}" for _ in range(150)]
    return [edited(base, rng, rng.randrange(0, 5)) for _ in range(copies)]


def test_sets_do_not_depend_on_the_batch():
    texts = ["A b c d e f", "a B", None, "", " \n", "a b c d e", "a b c d e a b c d e", "é\x0bü"]
    values, of = shingles(*text_bytes(pa.array(texts)))
    for k, text in enumerate(texts):
        one, _ = shingles(*text_bytes(pa.array([text], pa.string())))
        assert values[of[k] : of[k + 1]].tolist() == one.tolist() and len(one) == len(brute_set(text))
    assert len(signatures(values, of, 100)) == 5


def test_posterior_bound():
    least = least_agreements(Fraction(17, 20), 1e-6)
    rng = np.random.default_rng(1)
    # A pair at the threshold is hardly ever dropped, one far below nearly always.
    for n, m in least.items():
        assert (rng.binomial(n, 0.85, 100_000) < m).mean() < 1e-4
    assert (rng.binomial(100, 0.4, 10_000) < least[100]).mean() > 0.99


def test_smallest_reached():
    link = np.array([[0, 1, 0], [0, 0, 0]], bool)
    a, b = smallest_reached(np.array([5, 2]), np.array([7, 3, 1]), link)
    assert (a.tolist(), b.tolist()) == ([3, 2], [7, 3, 1])


@pytest.mark.parametrize("block", [1 << 20, 40_000])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    rng = random.Random(6)
    rows = list(enumerate(t for n in (120, 40, 2) for t in variants(rng, n)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(400)}" for _ in range(80))) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "One two"), (2004, rows[3][1]), (2005, "x " * 30_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, digest string")
    got = near_duplicates(docs, Fraction(85, 100)).collect()
    want = brute(rows, Fraction(85, 100))
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_linked_copies_are_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = list(enumerate(edited(base, rng, 1) for _ in range(400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 40_000)

    def unwanted(*_):
        raise AssertionError("pairs of one component")

    monkeypatch.setattr(minhash, "block_pairs", unwanted)
    assert {r.component_id for r in near_duplicates(docs, Fraction(85, 100)).collect()} == {0}


def test_pairs_of_blocks_leave_out_one_component(spark):
    # Under key 1 component 7 fills blocks 10 to 19, small ones are in block 20; key 2 has one component.
    rows = [(1, b, 7) for b in range(10, 20)] + [(1, 20, -1)] + [(2, b, 7) for b in range(10, 20)] + [(3, 19, 7), (3, 21, 8)]
    at = spark.createDataFrame(rows, "key long, block long, only long")
    got = sorted((r.x, r.y) for r in minhash.block_pairs(at).collect())
    assert got == sorted([(b, 20) for b in range(10, 21)] + [(19, 21)])


def test_sampled_pairs(spark):
    rows = [(1, c, 7, 100) for c in range(10, 60)] + [(1, 70, 8, 100), (1, 71, 9, 84)]
    at = spark.createDataFrame(rows, "key long, class_id long, comp long, n long")
    for turn in range(3):
        got = [(r.a, r.b) for r in minhash.sampled_pairs(at, Fraction(85, 100), turn).collect()]
        assert got and len(got) == len(set(got)) <= 50 and all(a < b == 70 for a, b in got)


@pytest.mark.parametrize("threshold", [Fraction(85, 100), Fraction(1, 2)])
def test_prefix_keys_lose_no_pair(spark, threshold):
    """Every pair of sets at the threshold shares a key, many pairs below it none."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 400)
    sets = []
    for k in range(120):
        kept = base[rng.random(400) < rng.uniform(0.7, 1)]
        sets.append(np.unique(np.concatenate((kept, rng.integers(0, 1 << 60, rng.integers(0, 60))))))
    sets += [np.array([7]), np.array([7]), np.array([7, 8]), rng.integers(0, 1 << 60, 9)]
    frame = spark.createDataFrame([(k, k, v.tobytes()) for k, v in enumerate(sets)], "class_id long, comp long, shingles binary")
    at = minhash.prefix_keys(frame, threshold)
    keys = {}
    for r in at.collect():
        keys.setdefault(r.key, set()).add(r.class_id)
    pairs = {(i, j) for of in keys.values() for i in of for j in of if i < j}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if both >= threshold * (len(a) + len(sets[j]) - both):
                assert (i, j) in pairs
    if threshold > Fraction(1, 2):
        assert len(pairs) < 0.5 * len(sets) ** 2 / 2


def test_bands_follow_the_threshold():
    for t in (Fraction(1, 2), Fraction(4, 5), Fraction(85, 100), Fraction(99, 100)):
        size = minhash.signature_size(t)
        assert (1 - float(t) ** minhash.ROWS) ** (size // minhash.ROWS) <= minhash.UNMET * 1.0001


def test_several_texts_of_one_id(spark):
    """Each row has the component of its own text."""
    one, two = ("a b c d e f g h", "k l m n o p q r")
    rows = [(5, one), (5, two), (3, one), (9, two)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, "d")], "doc_id long, text string")
    got = sorted((r.component_id is None, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(False, False), (False, True), (True, True)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, rng.randrange(2, 50)) for _ in range(40)] + [(7, 7)]
    low = {}
    for a, b in edges:
        x, y = low.get(a, a), low.get(b, b)
        low |= {k: min(x, y) for k, v in {**low, a: x, b: y}.items() if v in (x, y)}
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {k: v for k, v in low.items() if k in got} and set(low) - set(got) <= {7}
    assert components(frame.limit(0)).count() == 0
