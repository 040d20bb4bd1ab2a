import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import packing
from auditlake.llm.packing import best_fit, encoder, id_matrix, packed_ids, write_packed
from auditlake.llm.queries import PATTERN, TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_equals_a_plain_search(lengths):
    free, want = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(c, r) for r, c in enumerate(free) if c >= lengths[k]]
        if not fits:
            free.append(20)
            want.append([])
            fits = [(20, len(free) - 1)]
        c = min(fits)[0]
        row = min(fits)[1]
        free[row] -= lengths[k]
        want[row].append(k)
        assert c >= lengths[k]
    got = best_fit(np.array(lengths, np.int64), 20)
    assert sorted(k for row in got for k in row) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in row) <= 20 for row in got)
    assert sorted(sum(lengths[k] for k in row) for row in got) == sorted(20 - c for c in free)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "Übergang", "<|endoftext|>", "日本", "x\n"], k=rng.randrange(1, 200))), "s") for i in range(40)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "word " * 5000, None), (None, "null id", "s"), (3, rows[3][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    write_packed(packed_ids(docs, PATH, PATTERN, size=256), str(tmp_path / "packed"))
    got = spark.read.parquet(str(tmp_path / "packed"))
    table = pa.Table.from_pylist([r.asDict() for r in got.collect()])
    ids, places = id_matrix(table, 256), id_matrix(table, 256, "positions")
    parts = {}
    for k, r in enumerate(table.to_pylist()):
        bounds = r["cu_seqlens"]
        assert bounds[0] == 0 and bounds[-1] == r["n_ids"] <= 256
        assert (ids[k, r["n_ids"] :] == 50256).all()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], bounds, bounds[1:]):
            assert places[k, a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[k, a:b].tolist()))
    encode = encoder(PATH, PATTERN)
    for doc, text, _ in rows:
        if not text:
            assert doc not in parts
            continue
        whole = encode.encode_ordinary(text) + [50256]
        copies = 2 if doc == 3 else 1
        found = sorted(parts[doc])
        assert sum(len(x) for _, x in found) == copies * len(whole)
        for start, x in found:
            assert whole[start : start + len(x)] == x
    assert packed_ids(docs.limit(0), PATH, PATTERN).count() == 0
