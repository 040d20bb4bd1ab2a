"""Quality rules from the repeats inside a text, found on a suffix array of its words.

The suffix array of all words of a piece (words of different texts are different symbols, so no
match crosses a text) comes from prefix doubling that sorts only what is still tied. The common
prefix of neighbouring suffixes gives the longest-common-prefix intervals; a suffix lies in the
interval of its longest repeat, the larger of its two common prefixes. These longest repeats are
the occurrences of the maximal repeated substrings, and the union of their spans is what they cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import small_batches
from auditlake.llm.texts import SPACE, Words, mixed, pieces, span_hashes, text_bytes

WINDOW = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """What a text may have: repeats are counted from `repeat_words` words on."""

    least_words: int = 50
    window_percent: int = 50
    repeat_words: int = 6
    covered: float = 0.5
    longest: int = 50


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols; the last ranks have no ties."""
    n = len(symbols)
    _, inverse, count = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[inverse]
    tied = np.flatnonzero(count[inverse] > 1)
    levels, step = [rank], 1
    while len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.ones(len(key), bool)
        first[1:] = rank[tied[1:]] != rank[tied[:-1]]
        place = np.arange(len(key))
        group = np.maximum.accumulate(np.where(first, place, 0))
        own = np.maximum.accumulate(np.where(head, place, 0))
        fresh = rank.copy()
        fresh[tied] = rank[tied] + own - group
        alone = head.copy()
        alone[:-1] &= head[1:]
        rank, tied, step = fresh, tied[~alone], 2 * step
        levels.append(rank)
    return levels


def common_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and the common prefix of each suffix with the one before it."""
    n = len(levels[0])
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    length = np.zeros(n, np.int64)
    open_ = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right, got = order[open_ - 1], order[open_], np.zeros(len(open_), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + got, right + got
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        got += same.astype(np.int64) << k
    length[open_] = got
    return order, length


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs elsewhere too."""
    out = np.zeros(len(symbols), np.int64)
    if len(symbols):
        order, before = common_prefixes(suffix_ranks(symbols))
        out[order] = np.maximum(before, np.append(before[1:], 0))
    return out


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def _repeated_lines(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    start = np.unique(np.concatenate((at[:-1], np.flatnonzero(data == 10) + 1)))
    start = start[start < at[-1]]
    if not len(start):
        return np.zeros(len(at) - 1, np.int64)
    stop = np.append(start[1:], at[-1])
    end = stop - (data[stop - 1] == 10)
    filled = _per_text(~SPACE[data], np.append(start, at[-1])) > 0
    start, end = start[filled], end[filled]
    text = np.searchsorted(at, start, "right") - 1
    key = mixed(span_hashes(data, start, end) + text.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    return np.bincount(text, minlength=len(at) - 1) - np.bincount(text[first], minlength=len(at) - 1)


FIELDS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat",
]


def repetition(data: np.ndarray, at: np.ndarray, repeat_words: int) -> dict[str, np.ndarray]:
    """The FIELDS of every text of a piece."""
    words = Words(data, at)
    symbols = mixed(words.hashes() + words.text.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    repeat, n = longest_repeats(symbols), len(symbols)
    window, long_ = np.flatnonzero(repeat >= WINDOW), np.flatnonzero(repeat >= repeat_words)
    longest = np.zeros(words.n_texts, np.int64)
    np.maximum.at(longest, words.text, repeat)
    columns = [
        words.count,
        _per_text(~SPACE[data] & ((data & 0xC0) != 0x80), at),
        _per_text(_SYMBOL[data], at),
        _repeated_lines(data, at),
        _per_text(_covered(window, np.full(len(window), WINDOW), n), words.first),
        _per_text(_covered(long_, repeat[long_], n), words.first),
        longest,
    ]
    return dict(zip(FIELDS, columns))


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the counts of FIELDS, base_failed and kept for every row of documents (doc_id, text).

    base_failed: fewer than `least_words` words, or more than `window_percent` % of them in
    3-word windows that occur twice. A text that passes is kept if its repeats of at least
    `repeat_words` words cover at most the fraction `covered` of its words and none is longer
    than `longest` words. A null or empty text has no words and fails. Repeated rows get equal
    results, a null doc_id stays null, further columns are ignored. One text is held in memory
    at a time with about 100 bytes for each of its bytes.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            got = repetition(*text_bytes(batch.column("text")), limits.repeat_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(got[f].astype(np.int64)) for f in FIELDS)], ["doc_id", *FIELDS]
            )

    schema = ", ".join(f"{f} long" for f in ["doc_id", *FIELDS])
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    few = F.col("n_words") < limits.least_words
    rows = rows.withColumn("base_failed", few | (100 * F.col("n_repeat_words") > limits.window_percent * F.col("n_words")))
    fine = (F.col("covered_words") <= limits.covered * F.col("n_words")) & (F.col("longest_repeat") <= limits.longest)
    return rows.withColumn("kept", ~F.col("base_failed") & fine)
