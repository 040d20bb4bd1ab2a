"""BPE with word ends: encoding by a contiguous rank array for each word, and decoding.

The vocabulary file (JSON) gives merges by rank, a normaliser (canonical composition, lower case), a
pattern that cuts a text into words, and special tokens that are found in the text as it is. A word
is spelled byte by byte, its last symbol carrying the word end.

A short word holds two lists: the boundaries of its parts and the rank of each adjacent pair. The
lowest rank, leftmost first, is found by a scan; its inner boundary is deleted and the ranks on
either side are refreshed. A scan is a pass over a few numbers, which beats any ordered structure
while words are short; words of more than LONG bytes use a heap of candidates with equal results.
The new words of texts that come together have their arrays one after another and are cut side by
side. Words met before are looked up, up to KEPT of them.

Decoding joins the tokens of the ids with blanks, word ends included, as the file names no decoder.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditlake.llm.pieces import MergeTable, rounds
from auditlake.llm.shared import small_batches
from auditlake.llm.texts import pieces

LONG = 128
KEPT = 200_000
#: Bytes of text whose new words are cut side by side, from so many words on.
CHUNK, LEAST = 1 << 19, 32
#: Texts are read in slices of about this many characters that end before a blank.
SLICE = 1 << 20
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same on lower-case ASCII.
_ASCII_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_NEVER = 1 << 60
_BLANK = re.compile(r"[\t\n\x0b\x0c\r ]")


def _spelling() -> list[str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


class WordBpe:
    """A vocabulary file and the words it has cut."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            told = json.load(lines)
        model = told["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(model["merges"])}
        self.letter = dict(enumerate(_spelling()))
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut = regex.compile(WORD)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # Symbols as numbers: a token's is its id, those that are no token follow.
        symbols, self.size = dict(self.vocab), max(self.vocab.values()) + 1

        def number(symbol: str) -> int:
            return symbols.setdefault(symbol, self.size + len(symbols))

        self.inner, self.last = (np.array([number(self.letter[b] + end) for b in range(256)]) for end in ("", self.end))
        self.table = MergeTable({(number(a), number(b)): (k, number(a + b)) for (a, b), k in self.ranks.items()})
        self.path, self.file = path, None
        self.known = _Known(self)

    def pairs(self, text: str) -> tuple[list[str], str]:
        """The symbols of a word and their concatenation."""
        symbols = text.encode().decode("latin-1").translate(self.letter)
        symbols = [*symbols[:-1], symbols[-1] + self.end]
        return symbols, "".join(symbols)

    def short(self, word: str) -> list[int]:
        """Ids of a word by its rank array."""
        symbols, spelled = self.pairs(word)
        n = len(symbols)
        bounds = [*range(n), len(spelled)]
        ranks = [self.ranks.get(pair, _NEVER) for pair in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < _NEVER:
            i = ranks.index(best)
            del bounds[i + 1], ranks[i]
            middle = spelled[bounds[i] : bounds[i + 1]]
            if i:
                ranks[i - 1] = self.ranks.get((spelled[bounds[i - 1] : bounds[i]], middle), _NEVER)
            if i < len(ranks):
                ranks[i] = self.ranks.get((middle, spelled[bounds[i + 1] : bounds[i + 2]]), _NEVER)
        return [self.vocab[spelled[a:b]] for a, b in zip(bounds, bounds[1:])]

    def side_by_side(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word of at most LONG bytes, by the rank arrays of all of them at once."""
        raw = [(w, x) for w in words if len(x := w.encode()) <= LONG]
        data = np.frombuffer(b"".join(x for _, x in raw), np.uint8)
        first = np.concatenate(([0], np.cumsum([len(x) for _, x in raw], dtype=np.int64)))
        symbols = self.inner[data]
        symbols[first[1:] - 1] = self.last[data[first[1:] - 1]]
        final, count = rounds(self.table, symbols, first, np.zeros(0, np.uint64), 0.0)
        if len(final) and final.max() >= self.size:
            raise KeyError("a symbol that is no token")
        ids, at = final.astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(count)))).tolist()
        return {w: ids[a:b] for (w, _), a, b in zip(raw, at, at[1:])}

    def long(self, word: str) -> list[int]:
        """Ids of a word by a heap of candidate merges."""
        parts, _ = self.pairs(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (rank := self.ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j >= n or parts[j] != pair[1]:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (rank := self.ranks.get(new := (parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(heap, (rank, a, new))
        return [self.vocab[p] for p in parts if p]

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._words_of_file(text)
        # Lower case goes by character: no final sigma.
        return self.cut.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _words_of_file(self, text: str) -> list[str]:
        """For characters younger than this Python's tables: the file's own normaliser and pattern."""
        if self.file is None:
            from tokenizers import Tokenizer

            self.file = Tokenizer.from_file(self.path)
        back = {ord(c): b for b, c in self.letter.items()}
        found = self.file.pre_tokenizer.pre_tokenize_str(self.file.normalizer.normalize_str(text))
        return [bytes(back[ord(c)] for c in w).decode() for w, _ in found]

    def parts(self, text: str) -> Iterator[bytes | list[str]]:
        """The ids of special tokens, and between them the words of each slice."""
        for k, part in enumerate(self.at_special.split(text)):
            if k % 2:
                yield np.array([self.special[part]], "<u4").tobytes()
            else:
                yield from map(self.words, _slices(part))

    def told(self, parts: list[bytes | list[str]]) -> bytes:
        return b"".join(x if isinstance(x, bytes) else b"".join(map(self.known.__getitem__, x)) for x in parts)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers, slice by slice."""
        out = []
        for part in self.parts(text):
            self.known.learn([part])
            out.append(self.told([part]))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; several texts are held as words at once."""
        if len(texts) == 1:
            return [self.encode(texts[0])]
        found = [list(self.parts(t)) for t in texts]
        self.known.learn([part for parts in found for part in parts])
        return [self.told(parts) for parts in found]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of some ids, joined by blanks; ids that no token has are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids.tolist() if i in self.tokens)


class _Known(dict):
    """Ids of words as bytes; starts anew after KEPT words."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def learn(self, parts: list[bytes | list[str]]) -> None:
        """Cuts the new words of some parts side by side, if they are many."""
        words = set().union(*(x for x in parts if not isinstance(x, bytes)))
        new = [w for w in words if w not in self]
        if len(new) < LEAST or len(words) > KEPT:
            return
        if len(self) + len(new) > KEPT:
            self.clear()
            new = list(words)
        self.update(self.bpe.side_by_side(new))

    def __missing__(self, word: str) -> bytes:
        size = len(word.encode())
        ids = np.array(self.bpe.short(word) if size <= LONG else self.bpe.long(word), "<u4").tobytes()
        if size <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


def _slices(text: str) -> Iterator[str]:
    """Parts of a text that end before a blank, so that no word and no composed character is cut."""
    low = 0
    while len(text) - low > SLICE:
        found = _BLANK.search(text, low + SLICE)
        if not found:
            break
        yield text[low : found.start()]
        low = found.start()
    yield text[low:]


#: One vocabulary for each worker process.
_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def word_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids for every row of documents (doc_id, text).

    `ids` holds little-endian unsigned 32-bit numbers; `path` is a vocabulary file that every
    executor can read. Special tokens that a text spells out become their ids, none is added. A null
    or empty text, or one of blanks only, has no ids. Repeated rows get equal results, a null doc_id
    stays null, further columns are ignored, an empty table gives an empty table. A text is read in
    slices; memory grows with its ids and with its longest run without a blank.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches, "text", CHUNK):
            ids = bpe.encode_all([t or "" for t in batch.column("text").to_pylist()])
            count = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), count, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def word_texts(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text for every row of word_ids(); null ids decode to ''."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            text = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    rows = rows.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
