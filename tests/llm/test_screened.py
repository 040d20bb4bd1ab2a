import random

from corpus_pipeline import mixture, near_copies

from auditlake.llm import shared


def test_no_listed_row_is_screened_out(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.randrange(-(1 << 62), 1 << 62), "x") for _ in range(20_000)] + [(None, "y")], "id long, text string")
    ids = rows.where("id % 10 = 0").select("id")
    listed = {r.id for r in ids.collect()}
    for most in (shared.MOST_MAPS, 1):
        monkeypatch.setattr(shared, "MOST_MAPS", most)
        got = shared.screened(rows, "id", ids, "likely").collect()
        assert len(got) == 20_001 and listed == {r.id for r in got if r.likely} & listed
        assert sum(r.likely for r in got) - len(listed) < 0.15 * len(got)
    assert not any(r.likely for r in shared.screened(rows, "id", ids.limit(0), "likely").collect())


def shuffled(rows):
    """Sizes of the rows that exchanges hold which Spark cannot avoid: broadcasts are off."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_texts_stay_where_they_are(spark, monkeypatch):
    """near_copies shuffles the texts of copies only, mixture none; no table of theirs is left with signatures or sets."""
    import corpus_pipeline

    kept = []
    monkeypatch.setattr(corpus_pipeline, "screened", lambda rows, *a: kept.append(shared.screened(rows, *a)) or kept[-1])
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(2000)]
    rows = [(i, t, "aa", "s1", len(t)) for i, t in enumerate(texts)] + [(3000 + i, texts[i], "aa", "s2", 1) for i in range(40)] + [(1, texts[1], "aa", "s1", len(texts[1]))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(2000))
    assert kept[0].where(corpus_pipeline.LIKELY).count() < 200
    assert not any("hashpartitioning" in line for line in shuffled(mixture(spark, docs, "")))
