import random
from fractions import Fraction

from corpus_pipeline import STAGES
from tests.llm.test_minhash import brute, variants

from auditlake.llm.pieces import decode, load
from auditlake.llm.queries import TOKENIZERS
from auditlake.llm.secrets import base_spans

import numpy as np

SYLLABLES = {"aa": ["tha", "ing", "ent", "or"], "bb": ["ção", "mente", "dor", "é"]}


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 90)))
        rows.append([i, text, lang, rng.choice(["s1", "s1", "s2", None]), len(text)])
    rows[5][1] += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" '
    for k, text in enumerate(variants(rng, 6)):
        rows.append([200 + k, text, "aa", "s1", len(text)])
    rows.append([300, rows[0][1], "aa", "s2", 1])
    rows += [[301, None, None, None, None], [302, "", "aa", "s1", 0], [303, "12 34", None, "s1", 5], [304, rows[1][1] + " é" * 20_000, "bb", "s1", 9]]
    return rows


def test_stages(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([tuple(r) for r in corpus()], columns)
    seen = {}
    for name, stage in STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        seen[name] = (before, docs.collect())
        if name != "ids":
            assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {301, 302, 303}
    before, after = seen["near_copies"]
    groups = brute([(r.doc_id, r.text) for r in before], Fraction(4, 5))
    assert {r.doc_id for r in after} == {low for _, low in groups.values()}
    assert len(after) < len(before)
    before, after = seen["secrets"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert [r.text for r in after if r.doc_id == 5][0].endswith(" [secret]\" ")
    assert all(r.n_chars == len(r.text) and not base_spans(r.text) for r in after)
    before, after = seen["mixture"]
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after)
    words = sum(len(r.text.split()) for r in before)
    assert abs(sum(len(r.text.split()) for r in after) - words) <= 0.05 * words
    model = load(f"{TOKENIZERS}/piece_bpe_32k.model")
    before, after = seen["ids"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    for r in after:
        assert r.lossless and decode(model, np.array(r.ids), np.array([0, len(r.ids)]))[0].tobytes().decode() == texts[r.doc_id]


def test_rows_without_ids_repeated_rows_and_clashing_columns(spark):
    from corpus_pipeline import mixture, near_copies

    one, two = "a b c d e f g h", "k l m n o p q r s"
    rows = [(None, one, "aa", "s1", 1, 7, "x")] * 3 + [(None, two, "aa", "s2", 1, 7, "x"), (4, two, "aa", "s2", 1, 7, "x"), (4, two, "aa", "s2", 1, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, `copy` string")
    got = near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, two), (True, one)] and {r.copies for r in got} == {7}
    mixed = mixture(spark, docs, "")
    assert mixed.columns == docs.columns and {(r.copies, r["copy"]) for r in mixed.collect()} == {(7, "x")}
    # 24 words of s1 and 27 of s2 aim at three quarters and a quarter of 51; equal rows stay together.
    words = {s: sum(len(r.text.split()) for r in mixed.where(f"source = '{s}'").collect()) for s in ("s1", "s2")}
    assert words == {"s1": 24, "s2": 9}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
