import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import passages as passages_module
from auditlake.llm.passages import LENGTH, anchors, earlier_windows, repeated_passages, suffix_order
from auditlake.llm.texts import text_bytes


def brute(rows):
    first = {}
    data = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data[d] = (t or "").encode()
        for i in range(len(data[d]) - LENGTH + 1):
            first.setdefault(data[d][i : i + LENGTH], d)
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - LENGTH + 1):
            if first[b[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = True
        gone = gone[:-1]
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgé", k=rng.randrange(1, 8))) for _ in range(n))


def test_equal_strings_have_equal_anchors():
    rng = random.Random(1)
    passage = words(rng, 30)
    texts = [words(rng, 40) + passage + words(rng, 9), passage + words(rng, 50), "short", "ab" * 60]
    data, at = text_bytes(pa.array(texts))
    low, first, last, text = anchors(data, at)
    stands = {}
    for h, f, l, t in zip(low.tolist(), first.tolist(), last.tolist(), text.tolist()):
        for s in range(f, l + 1):
            assert at[t] <= s <= at[t + 1] - LENGTH
            assert stands.setdefault(data[s : s + LENGTH].tobytes(), h) == h
    assert sum(l - f + 1 for f, l in zip(first, last)) == sum(max(0, len(t.encode()) - LENGTH + 1) for t in texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=50, max_size=90), st.integers(0, 5)), min_size=1, max_size=8), st.text("ab", min_size=50, max_size=70))
def test_windows_equal_brute_force(rows, shared):
    segments = [s.encode() for s, _ in rows] + [shared.encode(), ("a" + shared).encode()]
    docs = np.array([d for _, d in rows] + [6, 7])
    least = {}
    for s, d in zip(segments, docs):
        for i in range(len(s) - LENGTH + 1):
            least[s[i : i + LENGTH]] = min(least.get(s[i : i + LENGTH], 99), d)
    want = [[i for i in range(len(s) - LENGTH + 1) if least[s[i : i + LENGTH]] < d] for s, d in zip(segments, docs)]
    assert [w.tolist() for w in earlier_windows(segments, docs)] == want


def test_suffix_order():
    rng = random.Random(3)
    data = np.frombuffer(("".join(rng.choices("ab", k=300)) * 2).encode(), np.uint8)
    raw = data.tobytes() + bytes(64)
    keys = [raw[i : i + 64] for i in suffix_order(data)]
    assert keys == sorted(keys)


@pytest.mark.parametrize("most", [1 << 21, 300])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(passages_module, "ANCHOR_BYTES", most)  # 300: most anchors go string by string
    rng = random.Random(4)
    passages = [words(rng, 25) for _ in range(4)] + ["x" * 80]
    rows = []
    for i in range(80):
        parts = [words(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 4))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), p[rng.randrange(0, 40) :])
        rows.append((i * 2, "".join(parts)))
    rows += [(1, rows[10][1]), (501, rows[10][1]), (502, None), (503, ""), (504, "short"), (505, "short"), (506, passages[4] * 3)]
    rows += [(507, words(rng, 30_000) + passages[0]), (20, rows[10][1])]
    want = brute(rows)
    rows += [(None, rows[5][1])]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, segment binary")
    got = repeated_passages(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == want
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert sum(v[1] for v in want.values()) > 3000
    assert repeated_passages(docs.limit(0)).count() == 0


def test_memory_of_the_transform():
    """The arrays of a block take at most 60 bytes per byte of its segments."""
    import tracemalloc

    rng = np.random.default_rng(3)
    segments = [bytes(rng.integers(97, 123, 100, dtype=np.uint8)) for _ in range(5000)]
    earlier_windows(segments[:10], np.arange(10))
    tracemalloc.start()
    earlier_windows(segments, np.arange(5000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(map(len, segments)), peak


def test_anchors_are_found_once(spark, monkeypatch):
    """The shuffle of anchors is made once for both of its readers, and anchors are not looked for again in texts that share some."""
    rng = random.Random(7)
    passage = words(rng, 40)
    docs = spark.createDataFrame([(i, words(rng, 40) + passage + words(rng, 9)) for i in range(20)], "doc_id long, text string")
    plans = {}
    kept = passages_module.written

    def told(rows, name):
        plans[name] = kept(rows, name) if name != "places" else None
        if name == "places":
            rows.collect()
            plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            plans["anchors"] = plan.count("ReusedExchange") + plan.count("ReusedQueryStage")
            plans[name] = kept(rows, name)
        return plans[name]

    monkeypatch.setattr(passages_module, "written", told)
    assert repeated_passages(docs).where("n_removed > 0").count() == 19
    assert plans["anchors"] > 0
    assert plans["spans"].columns == ["doc_id", "span"]
