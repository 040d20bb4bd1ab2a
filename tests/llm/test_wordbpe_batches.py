import random

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from auditlake.llm import wordbpe
from auditlake.llm.queries import TOKENIZERS
from auditlake.llm.wordbpe import WordBpe

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
TEXTS = ["Hello <|endoftext|> É é 123 ΑΣ don't", "", "a" * 127 + " " + "a" * 128 + " " + "é" * 65, " \t", "İ ﬁ 日本語 \U0001f600 \x1c\x85", "Σ" * 700]


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


def words(rng, n):
    return ["".join(rng.choices("aeinrsttthhe'éσ", k=rng.randrange(1, 40))) for _ in range(n)]


def test_words_side_by_side_equal_single_ones(bpe):
    rng = random.Random(4)
    told = words(rng, 600) + ["a", "x" * wordbpe.LONG, "é" * (wordbpe.LONG // 2), "日本語", "\U0001f600", "!", "the"]
    got = bpe.side_by_side(told + ["x" * (wordbpe.LONG + 1)])
    assert set(got) == set(told)
    for w in told:
        assert np.frombuffer(got[w], "<u4").tolist() == bpe.short(w)
    assert bpe.side_by_side([]) == {}


def test_new_words_of_a_batch_are_cut_together(monkeypatch):
    bpe, library = WordBpe(PATH), Tokenizer.from_file(PATH)
    texts = [" ".join(words(random.Random(k), 60)) for k in range(20)] + TEXTS
    cut = []
    monkeypatch.setattr(bpe, "short", cut.append)
    got = bpe.encode_all(texts)
    assert not cut
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.encode_all(texts[:1]) == got[:1] and bpe.encode_all([]) == []


def test_forgetting_and_slices_change_nothing(bpe, monkeypatch):
    texts = [" ".join(words(random.Random(k), 60)) for k in range(20)] + TEXTS
    whole = bpe.encode_all(texts)
    for kept, least, size in ((3, 1, 10), (40, 1, 25), (100, 2, 1 << 20), (500, 1, 300)):
        monkeypatch.setattr(wordbpe, "KEPT", kept)
        monkeypatch.setattr(wordbpe, "LEAST", least)
        monkeypatch.setattr(wordbpe, "SLICE", size)
        other = WordBpe(PATH)
        for k in range(0, len(texts), 4):
            assert other.encode_all(texts[k : k + 4]) == whole[k : k + 4]
            assert len(other.known) <= kept


def test_ascii_words_equal_the_pattern():
    cut, letters = regex.compile(wordbpe.WORD), [c for c in map(chr, range(128)) if not c.isupper()]
    for a in letters:
        for b in letters:
            text = f"{a}{b}x{a}'{b}1{a} '{a}{b}"
            assert wordbpe._ASCII_WORD.findall(text) == cut.findall(text)
