import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditlake.llm.langid import features, fit, held_out, identify, predictions, train
from auditlake.llm.texts import text_bytes

SYLLABLES = {"aa": ["tha", "ing", "ent", "or"], "bb": ["ção", "mente", "dor", "é"], "cc": ["sch", "ung", "keit", "ü"]}


def text(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_features_do_not_depend_on_the_batch():
    texts = ["Ab  cd", None, "", "é x", "ab cd", "a"]
    found = features(*text_bytes(pa.array(texts)))
    for k, one in enumerate(texts):
        alone, _ = features(*text_bytes(pa.array([one], pa.string())))
        for n, (index, of) in enumerate(zip(*found)):
            assert index[of[k] : of[k + 1]].tolist() == (alone[n].tolist() if n < len(alone) else [])


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text(lang, rng, rng.randrange(5, 60)), lang if i % 7 else None, lang))
    rows += [(900, None, "aa", ""), (901, "", "aa", ""), (902, "12 34 !", None, ""), (903, text("cc", rng, 40_000), "cc", "cc"), (None, "tha ing", "aa", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert len(got) == len(rows)
    right = [got[i].lang_pred == truth for i, _, _, truth in rows if truth]
    assert np.mean(right) > 0.98
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(docs.limit(0), model).count() == 0
    untaught = train(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in identify(docs.limit(3), untaught).collect()} == {"und"}


def test_calibrated_scores():
    rng = random.Random(8)
    pairs = [(text(l, rng, 3), l) for l in SYLLABLES for _ in range(300)]
    noisy = [(t, l if rng.random() < 0.8 else rng.choice(list(SYLLABLES))) for t, l in pairs]
    model = fit([t for t, _ in noisy], [l for _, l in noisy])
    _, score, _ = predictions(model, pa.array([text(l, rng, 3) for l in SYLLABLES for _ in range(100)]))
    assert 0.7 < score.mean() < 0.97
