import hashlib
import random
import unicodedata

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer, normalizers

from auditlake.llm import wordbpe
from auditlake.llm.queries import TOKENIZERS
from auditlake.llm.wordbpe import WordBpe, word_ids, word_texts

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
TEXTS = [
    "Hello  World's <|endoftext|> É é 123  x ΑΣ ΑΣΑ <|startoftext|>ok", "<|endoftext|><|endoftext|", "don't we'll THEY'RE 'S x.'s",
    "", " \t\n", "İstanbul ß ﬁ 日本語 \U0001f600\U0001f600 ‍́", "\x00\x1c\x85 　a", "a" * 700 + "!" * 900, "</w> <|startoftext|", "क़Å",
    "՘͸x Ɤ \U00010d50\U00016ea0y",  # younger than Python's tables
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


def same(bpe, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(bpe.encode(text), "<u4")
    assert ids.tolist() == want
    assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_equals_the_library(bpe, library):
    for text in TEXTS:
        same(bpe, library, text)
    rng = random.Random(2)
    letters = "aeinrstlo'éßσΣ .!?0\n"
    for _ in range(400):
        same(bpe, library, "".join(rng.choices(letters, k=rng.randrange(1, 300))))
    for _ in range(300):
        points = [rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0x20000)]) for _ in range(60)]
        same(bpe, library, "".join(chr(c) for c in points if not 0xD800 <= c < 0xE000))


def test_rank_array_equals_heap(bpe):
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choices("aeinrsttthhe", k=rng.randrange(1, 60)))
        assert bpe.short(word) == bpe.long(word)


def test_slices_change_nothing(bpe, monkeypatch):
    text = " ".join(TEXTS) + " e ́x  ́ y" * 30
    whole = bpe.encode(text)
    for size in (1, 3, 40):
        monkeypatch.setattr(wordbpe, "SLICE", size)
        assert bpe.encode(text) == whole


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "KEPT", 3)
    bpe = WordBpe(PATH)
    same(bpe, library, "the cat sat on the mat with the other cat")
    assert len(bpe.known) <= 3


def test_only_unassigned_characters_differ():
    """The pattern and lower case of this Python and of the library differ only where category is Cn."""
    cut, low = Tokenizer.from_file(PATH).pre_tokenizer, normalizers.Lowercase()
    mine = regex.compile(wordbpe.WORD)
    for c in map(chr, [*range(0x80, 0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0x11FFF), *range(0x1E000, 0x1FC00)]):
        if unicodedata.category(c) not in ("Cn", "Cs"):
            assert len(cut.pre_tokenize_str(f"a{c}{c}b.")) == len(mine.findall(f"a{c}{c}b."))
            assert low.normalize_str(c) == c.lower()


def test_table(spark, library):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(50, None, 7), (None, "no id", 7), (1, TEXTS[1], 7), (60, "long Text " * 300_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = word_texts(word_ids(docs, PATH), PATH).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert word_texts(word_ids(docs.limit(0), PATH), PATH).count() == 0


def test_query(spark, library):
    from auditlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_word_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
