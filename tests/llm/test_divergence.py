import random
import re
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import divergence
from auditlake.llm.divergence import counted, source_divergence, terms_of, tile_sums

COLUMNS = "doc_id long, text string, lang string, source string, rank int"


def brute(rows, least):
    """The contract, read plainly."""
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        found = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in found.items() if n >= least)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def corpus(seed, n=300, sources=6):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Gamma", "é", "straße", "日本", "x1y", "und", "rare%d", "tail", "É", "zz"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice([None, *(f"s{k}" for k in range(sources))])
        pick = rng.choices(words, weights=[5, 4, 3, 2, 2, 1, 1, len(source or ""), 2, 1, 1, 1], k=rng.randrange(0, 15))
        rows.append((i, " ".join(w % i if "%" in w else w for w in pick), lang, source, 1))
    rows += [(k, "Copy of beta beta\x00alpha", "en", f"s{k % 3}", 1) for k in range(90)]
    rows += [(500, None, "xx", "only", 1), (501, "", "yy", "a", 1), (501, "", "yy", "b", 1), (None, None, None, None, None), (502, "one", "zz", "a", 1)]
    return rows


def run(spark, rows, least=10):
    docs = spark.createDataFrame(rows, COLUMNS)
    return sorted(tuple(r) for r in source_divergence(docs, least).collect())


@pytest.mark.parametrize("least", [1, 10])
def test_equals_brute_force(spark, least):
    rows = corpus(least)
    assert run(spark, rows, least) == brute(rows, least)


def test_tiles_chunks_and_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(4, sources=14)
    for name, value in (("TILE", 3), ("CHUNK", 2), ("HELD", 5), ("TOGETHER", 40)):
        monkeypatch.setattr(divergence, name, value)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_text():
    text = "Wort é ".encode() * 400_000
    assert counted(text) == Counter(terms_of(text)) == {b"wort": 400_000, "é".encode(): 400_000}


def test_tile_sums_with_large_shares():
    rng = np.random.default_rng(1)
    left, right = (np.where(rng.random((4, 30)) < 0.4, rng.integers(1, 10**9, (4, 30)), 0) for _ in range(2))
    none_a, none_b = rng.integers(1, 50, 4), rng.integers(1, 50, 4)
    value, terms = tile_sums(left, right, none_a, none_b)
    for i in range(4):
        for j in range(4):
            cells = [(int(a) or int(none_a[i]), int(b) or int(none_b[j])) for a, b in zip(left[i], right[j]) if a or b]
            assert terms[i, j] == len(cells) and value[i, j] == sum((p - q) ** 2 // (p + q) for p, q in cells)


def test_shares_of_large_counts(spark):
    row = spark.sql("select 9000000000000000L as n, 9000000000000001L as total, 3000000L as terms")
    assert row.select(divergence.share(row.n, row.total, row.terms)).first()[0] == 1 + 10**9 * (9000000000000002) // (9000000000000001 + 6000000)
