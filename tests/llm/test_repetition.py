import collections
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm.repetition import Limits, longest_repeats, repetition, repetition_rules
from auditlake.llm.texts import text_bytes

WORD = r"[^\x20\x09-\x0D]+"


def brute(text, least):
    words = re.findall(WORD, text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    near = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best[i] = max(best[i], n)
    far = {i + k for i, n in enumerate(best) if n >= least for k in range(n)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            lines += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(near), len(far), max(best, default=0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é\n\t|#", max_size=60), min_size=1, max_size=6))
def test_counts_equal_brute_force(texts):
    got = repetition(*text_bytes(pa.array(texts)), 4)
    assert list(zip(*(v.tolist() for v in got.values()))) == [brute(t, 4) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_longest_repeats(symbols):
    def common(i, j):
        n = 0
        while max(i, j) + n < len(symbols) and symbols[i + n] == symbols[j + n]:
            n += 1
        return n

    want = [max((common(i, j) for j in range(len(symbols)) if j != i), default=0) for i in range(len(symbols))]
    assert longest_repeats(np.array(symbols, np.uint64)).tolist() == want


def test_edges_and_verdict(spark):
    rng = random.Random(3)
    clean = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200))
    passage = " ".join(clean.split()[:60])
    rows = [
        (1, clean, "x"), (2, None, "x"), (3, "", None), (4, "spam " * 300, "x"), (5, f"{clean} {passage}", "x"),
        (1, clean, "x"), (None, clean, "x"), (6, "é" * 300_000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = [r.asDict() for r in repetition_rules(docs).collect()]
    kept = collections.defaultdict(list)
    for r in got:
        kept[r["doc_id"]].append((r["base_failed"], r["kept"]))
    assert kept == {
        1: [(False, True)] * 2, 2: [(True, False)], 3: [(True, False)], 4: [(True, False)], 5: [(False, False)],
        None: [(False, True)], 6: [(True, False)],
    }
    assert {r["word_chars"] for r in got if r["doc_id"] == 6} == {300_000}
    loose = {r.doc_id: r.kept for r in repetition_rules(docs, Limits(longest=60)).collect()}
    assert loose[5]
    assert repetition_rules(docs.limit(0)).count() == 0
