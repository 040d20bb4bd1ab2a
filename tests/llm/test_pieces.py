import random

import numpy as np
import pyarrow as pa
import sentencepiece

from auditlake.llm import pieces
from auditlake.llm.pieces import decode, encode, encoded, id_digest, load
from auditlake.llm.queries import TOKENIZERS
from auditlake.llm.texts import text_bytes

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = [
    "Hello  World é x\n  tab\tü日本 😀 end ", " a", "a ", "", "  ", "\n", " " * 70 + "x", "a" * 300, "<0x0A> <s>", None,
    "internationalisation of tokenizers, unbelievably so; ", "Straße　ﬁ é",
]


def cut(texts, dropout, seed=0, variant=0):
    model = load(PATH)
    ids, at = encode(model, *text_bytes(pa.array(texts, pa.string())), np.full(len(texts), variant), seed, dropout)
    back, of = decode(model, ids, at)
    assert [back[a:b].tobytes().decode() for a, b in zip(of[:-1], of[1:])] == [t or "" for t in texts]
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_without_dropout_equals_the_library():
    rng = random.Random(1)
    texts = TEXTS + [" ".join("".join(rng.choices("aeinrstlé", k=rng.randrange(1, 60))) for _ in range(40)) for _ in range(30)]
    assert cut(texts, 0.0) == sentencepiece.SentencePieceProcessor(model_file=PATH).encode([t or "" for t in texts])


def test_dropout_varies_and_repeats(monkeypatch):
    texts = [t or "" for t in TEXTS] * 3 + ["▁ literal ▁▁ blank sign"]
    first = cut(texts, 0.3, seed=1)
    assert first == cut(texts, 0.3, seed=1)
    assert first != cut(texts, 0.3, seed=2) and first != cut(texts, 0.3, seed=1, variant=1)
    assert sum(map(len, first)) > sum(map(len, cut(texts, 0.0)))
    # The heap of one unit and the rounds of many give the same pieces, cut before or not.
    monkeypatch.setattr(pieces, "LONG", 0)
    load(PATH).known = pieces.Known()
    assert cut(texts, 0.3, seed=1) == first
    monkeypatch.setattr(pieces, "KEPT", 5)
    monkeypatch.setattr(pieces, "LONG", 48)
    load(PATH).known = pieces.Known()
    assert [cut([t], 0.3, seed=1)[0] for t in texts] == first


def test_skipped_share():
    """One possible merge in every unit: it is skipped at the chosen rate."""
    words = [chr(0x4E00 + i) + "th" for i in range(4000)]
    model = load(PATH)
    free = [t for t in words if t[0] not in model.symbol]
    n = sum(len(x) for x in cut(free, 0.25)) - sum(len(x) for x in cut(free, 0.0))
    assert 0.2 < n / len(free) < 0.3


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(50, "long " * 50_000, "x"), (None, "no id", "x"), (1, TEXTS[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encoded(docs, PATH, seed=3, dropout=0.2).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert {len(r.ids) for r in got if r.doc_id in (3, 9)} == {0}
    assert sorted(r.n_ids for r in id_digest(encoded(docs, PATH, seed=3, dropout=0.2)).collect()) == sorted(len(r.ids) for r in got)
    assert encoded(docs.limit(0), PATH).count() == 0
