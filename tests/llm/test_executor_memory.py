import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tests.llm.test_driver_memory import collections

from auditlake.llm import pieces, secrets, shared
from auditlake.llm.queries import TOKENIZERS
from auditlake.llm.texts import pieces as cut


def test_executors_are_collected(spark):
    before = collections(spark)
    shared.collect_executors(spark)
    assert collections(spark) > before


def test_near_copies_leave_small_heaps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "collect_executors", lambda s: seen.append(s) or shared.collect_executors(s))
    docs = spark.createDataFrame([(1, "a b c", "s", "x"), (2, "a b c", "s", "x"), (3, None, None, None)], "doc_id long, text string, source string, lang string")
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and len(seen) == 1


def taken(work) -> float:
    """MB at most that `work` holds at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_holds_little(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh    "), 4000)) for _ in range(512)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(512)), "text": texts})
    model = pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")

    def ids() -> list:
        out = []
        for x in cut([batch], "text", pieces.CHUNK):
            data, at = pieces.text_bytes(x.column("text"))
            out += pieces.encode(model, data, at, np.zeros(len(at) - 1, np.int64), 1, 0.1)[0].tolist()
        return out

    assert taken(lambda: [len(b) for b in secrets._scan([batch])]) < 40
    small = ids()
    monkeypatch.setattr(model, "known", pieces.Known())

    def slowly() -> None:
        for x in cut([batch], "text", pieces.CHUNK):
            data, at = pieces.text_bytes(x.column("text"))
            pieces.encode(model, data, at, np.zeros(len(at) - 1, np.int64), 1, 0.1)

    assert taken(slowly) < 70
    monkeypatch.setattr(pieces, "CHUNK", 1 << 22)
    assert ids() == small
