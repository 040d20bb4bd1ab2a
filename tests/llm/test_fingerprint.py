import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm.fingerprint import (
    BINS, WINDOW, compare_neighbours, digests, edited, entropies, entropy_histogram, fingerprints, likeness, rarity,
)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklé", k=rng.randrange(2, 9))) for _ in range(n))


def test_entropies_equal_brute_force():
    rng = random.Random(1)
    data = np.frombuffer((words(rng, 60) + "a" * 90 + words(rng, 20)).encode(), np.uint8)
    want = []
    for i in range(len(data) - WINDOW + 1):
        count = np.bincount(data[i : i + WINDOW])
        share = count[count > 0] / WINDOW
        want.append(-(share * np.log2(share)).sum() / math.log2(WINDOW) * BINS)
    assert np.abs(entropies(data) - np.array(want)).max() <= 0.51
    assert len(entropies(data[:63])) == 0


def test_digest_is_that_of_the_text_alone():
    rng = random.Random(2)
    texts = [words(rng, n) for n in (400, 5, 20, 0, 12, 3000)] + ["é" * 500, None, "x" * 64, "ab" * 63]
    rank = rarity(np.random.default_rng(1).integers(0, 9, BINS + 1))
    assert digests(pa.array(texts), rank) == [digests(pa.array([t], pa.string()), rank)[0] for t in texts]


def test_likeness_orders_texts():
    rng = random.Random(3)
    a, b = words(rng, 2000), words(rng, 2000)
    rank = rarity(np.bincount(entropies(np.frombuffer((a + b).encode(), np.uint8)), minlength=BINS + 1))
    da, db, dc = digests(pa.array([a, b, edited(a, b)]), rank)
    assert likeness(da, da) == 1 and likeness(da, db) < 0.05 < 0.4 < likeness(da, dc) < 1
    assert likeness(da, dc) == likeness(dc, da)


def test_neighbours(spark):
    rng = random.Random(4)
    rows = [(i * 3, words(rng, rng.randrange(0, 300)), "s") for i in range(60)]
    rows += [(1000, None, "s"), (1001, "", None), (1002, words(rng, 30_000), "s"), (9, rows[3][1], "s"), (None, "null id", "s")]
    rows[20] = (60, rows[21][1], "s")
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = compare_neighbours(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id = {r.doc_id: r for r in got}
    for row, after in zip(ordered, ordered[1:] + ordered[:1]):
        r, text = by_id[row[0]], row[1] or ""
        third = len(text) // 3
        want = text[: len(text) - third] + (after[1] or "")[:third]
        assert r.n_chars == len(text)
        if row[0] != 9:
            assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[63].near_next == 1.0 and by_id[60].fingerprint == by_id[63].fingerprint
    rank = rarity(entropy_histogram(docs))
    assert {r.digest for r in fingerprints(docs.where("doc_id = 9"), rank).collect()} == set(digests(pa.array([rows[3][1]]), rank))
    one = compare_neighbours(docs.where("doc_id = 1002")).first()
    assert one.near_next == 1.0 and one.near_edited > 0.3
    assert compare_neighbours(docs.limit(0)).count() == 0


def test_null_rank_bins():
    assert rarity(np.zeros(BINS + 1, np.int64))[0] == 0
    assert pytest.approx(1.0) == likeness(*digests(pa.array(["a", "a"]), rarity(np.zeros(BINS + 1, np.int64))))
