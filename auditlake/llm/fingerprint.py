"""Document fingerprints from improbable features, kept in chained Bloom filters.

Every window of 64 bytes has an entropy; how rare its (rounded) entropy is over the whole corpus is
the window's rank. A window is a feature if it is the lowest-ranked of 64 neighbours often enough.
Features go into Bloom filters of 2048 bits, five bits each, a new filter after 160 features. Two
fingerprints are compared filter by filter: the bits they share, between the number expected by
chance and the largest possible one, give a value from 0 to 1; the mean over the filters of the
shorter chain of their best partners is the likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import small_batches, written
from auditlake.llm.texts import mixed, pieces, text_bytes

WINDOW = 64
NEIGHBOURS = 64
#: A window has to be the lowest of this many of the neighbourhoods it is in.
POPULAR = 16
BINS = 1000
#: Windows with an entropy outside (in thousandths of the largest, 6 bits) are never features.
LEAST_ENTROPY, MOST_ENTROPY = 100, 990
FILTER_BYTES, FEATURE_BITS, FEATURES = 256, 5, 160
#: Shared bits expected by chance are raised by this many standard deviations.
DEVIATIONS = 3.0

_COUNT = np.arange(WINDOW + 1)
#: c log2 c, scaled to whole numbers so that running sums are exact.
_TERM = np.round(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_TERM)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy bin (0 to BINS) of each window of `data`."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    # How many of the 63 bytes before and after each byte equal it.
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    same = np.empty(len(data), np.uint8)
    for k in range(1, WINDOW):
        part = same[k:]
        np.equal(data[k:], data[:-k], out=part.view(bool))
        before[k:] += part
        after[:-k] += part
    first = int(_TERM[np.bincount(data[:WINDOW], minlength=256)].sum())
    # From a window to the next: its first byte leaves, then a byte enters among the 63 that stay.
    # `after` counts the 63 bytes that follow, all in the window that the byte leaves.
    gone, come = after[: n - 1], before[WINDOW:]
    total = np.empty(n, np.int64)
    total[0] = first
    np.cumsum(_STEP[come] - _STEP[gone], out=total[1:])
    total[1:] += first
    entropy = np.log2(WINDOW) - total / ((1 << 20) * WINDOW)
    return np.rint(entropy * (BINS / np.log2(WINDOW))).astype(np.int16)


def rarity(histogram: np.ndarray) -> np.ndarray:
    """Rank of each entropy bin: 1 for the rarest one in use; 0 for bins that are never features."""
    bins = np.arange(BINS + 1)
    rank = np.zeros(BINS + 1, np.int64)
    order = np.lexsort((bins, histogram))
    rank[order] = np.arange(1, BINS + 2)
    rank[(bins < LEAST_ENTROPY) | (bins > MOST_ENTROPY)] = 0
    return rank


def feature_windows(data: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the windows of all texts that are features, ascending."""
    ranks = rank[entropies(data)]
    size = np.diff(at) - WINDOW + 1  # windows of each text
    wide = np.clip(size, 1, NEIGHBOURS)
    found = [_lowest(ranks, at, np.where(wide == NEIGHBOURS, size, 0), NEIGHBOURS)]
    # Texts with fewer windows have one neighbourhood of all of them.
    for k in np.flatnonzero((size > 0) & (wide < NEIGHBOURS)):
        found.append(_lowest(ranks[at[k] : at[k] + size[k]], np.array([0]), size[k : k + 1], int(wide[k])) + at[k])
    return np.sort(np.concatenate(found))


def _lowest(ranks: np.ndarray, at: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
    """Windows that are the lowest of enough neighbourhoods of `wide` windows inside a text.

    Of equal ranks the leftmost counts.
    """
    n = len(ranks)
    if n < wide:
        return np.zeros(0, np.int64)
    worst = BINS + 2
    least, have = np.where(ranks > 0, ranks, worst) * n + np.arange(n), 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    hoods = np.maximum(size - wide + 1, 0)
    begin = at[: len(size)][hoods > 0]
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + hoods[hoods > 0], minlength=n + 1)
    least = least[(np.cumsum(edge)[: len(least)] > 0) & (least < worst * n)] % n
    wins = np.bincount(least, minlength=n)
    start = np.flatnonzero(wins)
    need = np.minimum(POPULAR, np.maximum(1, hoods // 4))
    return start[wins[start] >= need[np.searchsorted(at, start, "right") - 1]]


def _hashed(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window."""
    views = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[start]
    words = np.ascontiguousarray(views).view("<u8")
    out = np.zeros(len(start), np.uint64)
    for k in range(WINDOW // 8):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return out


def digests(texts: pa.Array, rank: np.ndarray) -> list[bytes]:
    """The chained filters of each text, one after another; at least one filter.

    A text without features (shorter than a window, or too uniform) has its whole as one feature.
    """
    data, at = text_bytes(texts)
    start = feature_windows(data, at, rank)
    owner = np.searchsorted(at, start, "right") - 1
    hashed = _hashed(data, start) if len(start) else np.zeros(0, np.uint64)
    count = np.bincount(owner, minlength=len(at) - 1)
    bare = np.flatnonzero(count == 0)
    whole = [hashlib.blake2b(data[at[k] : at[k + 1]].tobytes(), digest_size=8).digest() for k in bare]
    place = np.arange(len(start)) - (np.cumsum(count) - count)[owner]
    filters = np.maximum(1, -(-count // FEATURES))
    first = np.cumsum(filters) - filters
    row = np.concatenate((first[owner] + place // FEATURES, first[bare]))
    hashed = np.concatenate((hashed, np.frombuffer(b"".join(whole), "<u8")))
    bits = np.zeros((filters.sum(), FILTER_BYTES * 8), bool)
    for k in range(FEATURE_BITS):
        bits[row, ((hashed >> np.uint64(11 * k)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[f : f + n].tobytes() for f, n in zip(first, filters)]


def likeness(a: bytes, b: bytes) -> float:
    """Likeness of two digests, 0 to 1, the same either way; equal digests have 1."""
    if a == b:
        return 1.0
    left, right = (np.frombuffer(x, "<u8").reshape(-1, FILTER_BYTES // 8) for x in (a, b))
    if len(left) == len(right):
        return (_toward(left, right) + _toward(right, left)) / 2
    return _toward(left, right) if len(left) < len(right) else _toward(right, left)


def _toward(left: np.ndarray, right: np.ndarray) -> float:
    bits = FILTER_BYTES * 8
    shared = np.bitwise_count(left[:, None] & right[None]).sum(2).astype(np.float64)
    n_left, n_right = (np.bitwise_count(x).sum(1).astype(np.float64) for x in (left, right))
    chance = n_left[:, None] * n_right / bits
    floor = chance + DEVIATIONS * np.sqrt(chance * (1 - n_left[:, None] / bits) * (1 - n_right / bits))
    most = np.minimum(n_left[:, None], n_right)
    best = (np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1) * (most > floor)).max(1)
    # A last, short filter says less than a full one.
    return float((best * n_left).sum() / n_left.sum())


# ---- over tables

def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS + 1, np.int64)
    for batch in pieces(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        bins = entropies(data)
        # Windows over the edge of two texts are none of a text.
        edge = np.bincount(np.maximum(at[1:-1] - WINDOW + 1, 0), minlength=len(data) + 1) - np.bincount(at[1:-1], minlength=len(data) + 1)
        inside = np.cumsum(edge)[: len(bins)] == 0
        total += np.bincount(bins[inside], minlength=BINS + 1)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bin", "n"])


def entropy_histogram(docs: DataFrame) -> np.ndarray:
    """Windows of all texts by entropy bin; only the sums of 1001 bins are collected."""
    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_histograms, "bin long, n long")
    out = np.zeros(BINS + 1, np.int64)
    for r in rows.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id and digest (binary) for every row of documents (doc_id, text); a null text is empty."""
    rank = rarity(entropy_histogram(docs)) if rank is None else rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = pa.array(digests(batch.column("text"), rank), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
_EDGE = {"part": pa.int64(), "edge": pa.string(), "text": pa.string()}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}


def _schema(fields: dict) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in fields.items())


def compared(ids: list, texts: list[str], following: list[str], rank: np.ndarray) -> dict[str, list]:
    """Results of texts next to the text that follows each of them."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, other, after = (digests(pa.array(x, pa.string()), rank) for x in (texts, changed, following))
    plain = [[base64.b64encode(d).decode() for d in x] for x in (own, other)]
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], *plain,
        [likeness(a, b) for a, b in zip(own, other)], [likeness(a, b) for a, b in zip(own, after)],
    ]
    return dict(zip(_RESULT, columns))


def _batch(columns: dict, fields: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f, [None] * n), kind) for f, kind in fields.items()], list(fields))


def _part(rank: np.ndarray):
    """An ordered partition -> results of all but its last row, and its first and last row as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, begun = TaskContext.get().partitionId(), [], [], False
        fields = _RESULT | _EDGE
        for batch in pieces(batches, "text"):
            ids += batch.column("doc_id").to_pylist()
            texts += batch.column("text").fill_null("").to_pylist()
            if not begun:
                yield _batch({"doc_id": ids[:1], "part": [part], "edge": ["first"], "text": texts[:1]}, fields)
                begun = True
            if len(ids) > 1:
                yield _batch(compared(ids[:-1], texts[:-1], texts[1:], rank), fields)
                ids, texts = ids[-1:], texts[-1:]
        if begun:
            yield _batch({"doc_id": ids, "part": [part], "edge": ["last"], "text": texts}, fields)

    return run


def _edges(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(compared(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), rank), _RESULT)

    return run


#: A partition of the ordered documents has about so many on large tables.
PART_ROWS = 1 << 16


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and two likenesses.

    Documents follow each other by descending doc_id (a null id last, repeated ids by a hash of
    their texts); after the last comes the first. Texts are shuffled once, into ranges of ids, and
    each range is walked in order. The last document of a range meets the first one of the next
    range in a small second step. A null text is empty; a single document follows itself. An empty
    table gives an empty table; further columns are ignored.
    """
    spark = docs.sparkSession
    rank = rarity(entropy_histogram(docs))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // PART_ROWS)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = written(rows.select("doc_id", "text").mapInArrow(_part(rank), _schema(_RESULT | _EDGE)), "neighbours")
    # The window sees one row of two numbers for each range.
    first = done.where("edge = 'first'")
    ranges = first.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    ranges = ranges.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    last = done.where("edge = 'last'").join(ranges, "part").select("doc_id", "text", F.col("next").alias("part"))
    pairs = last.join(first.select("part", F.col("text").alias("after")), "part").select("doc_id", "text", "after")
    return done.where("edge is null").select(*_RESULT).union(pairs.mapInArrow(_edges(rank), _schema(_RESULT)))
