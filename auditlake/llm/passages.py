"""Repeated passages, byte by byte, on Burrows-Wheeler transforms of the places that may repeat.

1. A text is cut at anchors: of the 20-byte strings in each run of 31, the one with the lowest hash.
   Every 50-byte string holds an anchor that depends on its own bytes only, so equal 50-byte strings
   have equal anchors. Anchors that only one text has are left out; of the others the bytes around
   them, all 50-byte strings they stand for, go on as a segment.
2. Segments of one anchor come together in a task, equal ones as one, and are sorted by their suffixes. From the
   Burrows-Wheeler transform, intervals of suffixes with a common prefix are expanded backwards,
   breadth first: round l finds the neighbouring suffixes whose common prefix has length l. The
   expansion stops at the minimum length; neighbours not separated by then share at least 50 bytes.
   Where very many texts share an anchor in different surroundings, its segments are not sorted in
   one task: their 50-byte strings are grouped by Spark, with equal results.
3. The smallest document of each class of such suffixes decides which windows are repeats, and the
   union of a document's windows is what it loses.

A text that equals one with a smaller id is a repeat as a whole and takes no part in 1 to 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import lean, release, small_batches, written
from auditlake.llm.texts import pieces, span_hashes, text_bytes

LENGTH = 50
GRAM = 20
STARTS = LENGTH - GRAM + 1
#: Suffixes are ordered by so many bytes; at least LENGTH.
ORDER = 72
#: Segments are sorted in blocks of whole anchors with about this many bytes.
BLOCK_BYTES = 1 << 18
#: Segments of an anchor with more bytes than this are compared string by string over many tasks.
ANCHOR_BYTES = 1 << 21
_NONE = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of data[i : i + GRAM] for each i."""
    n = max(len(data) - GRAM + 1, 0)
    at = np.arange(n)
    return span_hashes(data, at, at + GRAM)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start, text) of the anchors of all texts.

    The anchor stands for the 50-byte strings that begin at first..last start.
    """
    empty = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return empty.view(np.uint64), empty, empty, empty
    least = gram_hashes(data)
    have = 1
    while have < STARTS:
        step = min(have, STARTS - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    hoods = np.maximum(np.diff(at) - LENGTH + 1, 0)
    full = hoods > 0
    edge = np.bincount(at[:-1][full], minlength=n + 1) - np.bincount(at[:-1][full] + hoods[full], minlength=n + 1)
    start = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    if not len(start):
        return empty.view(np.uint64), empty, empty, empty
    low = least[start]
    text = np.searchsorted(at, start, "right") - 1
    # Starts in a row with one lowest hash have one anchor; a repeated gram only makes it stand for more.
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1
    return low[head], start[head], start[last], text[head]


# ---- the transform

def suffix_order(data: np.ndarray) -> np.ndarray:
    """Positions in the order of their next ORDER bytes; zeros follow the end."""
    n = len(data)

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, x.dtype)
        out[: n - k] = x[k:]
        return out

    key = data.astype(np.uint64)
    for k in (1, 2, 4):
        key = (key << np.uint64(8 * k)) | shifted(key, k)
    # Places fit 32 bits, as a task holds far less than 2 GB; they are what the memory of a task goes to.
    places = np.arange(n, dtype=np.int32)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, places, 0))
    size = 8
    while size < ORDER:
        alone = head.copy()
        alone[:-1] &= head[1:]
        place = np.flatnonzero(~alone)
        if not len(place):
            break
        tied = order[place]
        # Three ranks of `size` bytes each; blocks are far below the 2 ** 21 positions that fit.
        first = rank[tied].astype(np.int64)
        second, third = (np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)] + 1, 0) for k in (size, 2 * size))
        key = (((first << 21) + second) << 21) + third if n < 1 << 21 else _packed(first, second, third)
        by = np.argsort(key)
        order[place], key = tied[by], key[by]
        new = np.ones(len(place), bool)
        new[1:] = key[1:] != key[:-1]
        head[place] = new
        rank[order] = np.maximum.accumulate(np.where(head, places, 0))
        size *= 3
    return order


def _packed(*ranks: np.ndarray) -> np.ndarray:
    """One number for each row of ranks, in their order."""
    order = np.lexsort(ranks[::-1])
    new = np.zeros(len(order), bool)
    for r in ranks:
        new[1:] |= r[order[1:]] != r[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def separated(data: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which neighbours in the suffix order have a common prefix shorter than `length`.

    Entry j tells it of the suffixes j - 1 and j. `data` begins and ends with ORDER zeros.
    """
    n = len(data)
    before = data[order - 1]  # the transform; the byte before the first one is the last
    first = data[order]
    to = np.empty(n, np.int32)
    to[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    apart = np.zeros(n + 1, bool)
    apart[0] = apart[n] = True
    owner = np.full(n + 2, -1, np.int32)
    left, right = np.array([0], np.int32), np.array([n - 1], np.int32)
    for _ in range(length):
        if not len(left):
            break
        width = right - left + 1
        interval = np.repeat(np.arange(len(left), dtype=np.int32), width)
        inside = np.arange(len(interval), dtype=np.int32) - np.repeat((np.cumsum(width) - width - left).astype(np.int32), width)
        target = to[inside]
        owner[target + 1] = interval
        ends = (owner[target + 2] != interval) | (first[np.minimum(target + 1, n - 1)] != first[target])
        begins = (owner[target] != interval) | (first[np.maximum(target - 1, 0)] != first[target])
        right, left = np.sort(target[ends]), np.sort(target[begins])
        owner[target + 1] = -1
        fresh = ~apart[right + 1]
        apart[right[fresh] + 1] = True
        left, right = left[fresh], right[fresh]
    return apart[:n]


def earlier_windows(segments: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each segment: starts of its 50-byte strings that a smaller document among `docs` has too."""
    gap = np.zeros(ORDER, np.uint8)
    size = np.array([len(s) for s in segments])
    data = np.concatenate((gap, np.frombuffer(b"\0".join(segments) + b"\0", np.uint8), gap))
    begin = ORDER + np.cumsum(size + 1) - size - 1
    order = suffix_order(data)
    apart = separated(data, order)
    owner = np.full(len(data), -1, np.int32)
    window = np.zeros(len(data), bool)
    for k, (b, s) in enumerate(zip(begin, size)):
        owner[b : b + s] = k
        window[b : b + s - LENGTH + 1] = True
    valid = window[order]
    doc = np.where(valid, docs[owner[order]], _NONE)
    least = np.minimum.reduceat(doc, np.flatnonzero(apart))[np.cumsum(apart) - 1]
    found = order[valid & (least < doc)]
    found.sort()
    of = owner[found]
    cut = np.searchsorted(of, np.arange(len(segments) + 1))
    return [found[a:b] - begin[k] for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]


# ---- over tables

def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> their anchors; `place` is the first byte of the anchor's segment and, in the low half, its size."""
    for batch in pieces(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        low, first, last, text = anchors(data, at)
        digest = batch.column("digest").to_numpy()[text]
        place = ((first - at[text]) << 32) + (last + LENGTH - first)
        yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(digest), pa.array(place)], ["anchor", "digest", "place"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of a text at the listed places."""
    for batch in pieces(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        places = batch.column("places")
        flat, count = places.flatten(), places.value_lengths().to_numpy()
        anchor, place = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        size, place = place & 0xFFFFFFFF, place >> 32
        first = place + np.repeat(at[:-1], count)
        offsets = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(offsets[-1], dtype=np.int32) + np.repeat((first - offsets[:-1]).astype(np.int32), size)
        segment = pa.BinaryArray.from_buffers(
            pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[inside])]
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchor), pa.array(span_hashes(data, first, first + size).view(np.int64)), segment,
                pa.array(np.repeat(batch.column("doc_id").to_numpy(), count)), pa.array(place.astype(np.int32)),
                pa.array(size.astype(np.int32)),
            ],
            ["anchor", "segment_id", "segment", "doc_id", "place", "size"],
        )


def _packed_spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (begin.astype(np.int64) << 32) + end


def _runs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of ascending starts of 50-byte strings that overlap or touch."""
    cut = np.flatnonzero(np.diff(windows) > LENGTH)
    return windows[np.concatenate(([0], cut + 1))], windows[np.append(cut, len(windows) - 1)]


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments ordered by anchor -> (doc_id, span): what their documents lose to smaller ones."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        key, kind, docs, place, size = (rows.column(c).to_numpy() for c in ("anchor", "segment_id", "doc_id", "place", "size"))
        order = np.lexsort((docs, kind, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (kind[order[1:]] != kind[order[:-1]])
        head = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        least = docs[head]
        # A later document loses the whole segment, the first one what even earlier ones have.
        later = docs > least[of]
        doc, span = [docs[later]], [_packed_spans(place[later], place[later] + size[later])]
        # An anchor's only segment shares its windows with no other one.
        same = key[head[1:]] == key[head[:-1]]
        several = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(several):
            found = earlier_windows(rows.column("segment").take(pa.array(head[several])).to_pylist(), least[several])
            runs = {k: _runs(w) for k, w in zip(several.tolist(), found) if len(w)}
            hit = np.zeros(len(head), bool)
            hit[list(runs)] = True
            for row in np.flatnonzero(hit[of] & ~later).tolist():
                begin, last = runs[of[row]]
                doc.append(np.repeat(docs[row], len(begin)))
                span.append(_packed_spans(place[row] + begin, place[row] + last + LENGTH))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(span))], ["doc_id", "span"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("segment").nbytes
        if size >= BLOCK_BYTES:
            rows = pa.Table.from_batches(held)
            key = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield solved(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(b.column("segment").slice(0).nbytes for b in held)
    if held:
        yield solved(pa.Table.from_batches(held))


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the starts and ends of repeated bytes -> what is left of them."""
    for batch in pieces(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        spans = batch.column("spans")
        flat = spans.flatten().to_numpy()
        shift = np.repeat(at[:-1], spans.value_lengths().to_numpy())
        begin, end = (flat >> 32) + shift, (flat & 0xFFFFFFFF) + shift
        gone = covered(len(data), begin, end)
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        first = at[:-1][at[:-1] < len(data)]
        starts[first] = gone[first]
        sums, runs = (np.concatenate(([0], np.cumsum(x))) for x in (gone, starts))
        left, kept_at = data[~gone].tobytes(), at - sums[at]
        digest = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(sums[at])), pa.array(np.diff(runs[at])), pa.array(digest, pa.string())],
            ["doc_id", "n_removed", "n_spans", "kept_sha256"],
        )


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def spread_windows(segments: DataFrame) -> DataFrame:
    """(anchor, segment_id, least, windows) of distinct segments, for anchors with more of them than a task should hold:
    the smallest document of each and the starts of its 50-byte strings that a smaller one has.

    Every 50-byte string of a segment is a row; the smallest document of equal strings is taken
    before they are shuffled.
    """
    place = F.explode(F.sequence(F.lit(0), F.octet_length("segment") - LENGTH)).alias("place")
    rows = segments.select("anchor", "segment_id", "doc_id", "segment", place)
    rows = rows.select("anchor", "segment_id", "doc_id", "place", F.expr(f"substring(segment, place + 1, {LENGTH})").alias("string"))
    least = rows.groupBy("anchor", "string").agg(F.min("doc_id").alias("least"))
    found = rows.join(least, ["anchor", "string"]).where("least < doc_id").groupBy("anchor", "segment_id")
    found = found.agg(F.array_sort(F.collect_list("place")).alias("windows"))
    out = segments.select("anchor", "segment_id", F.col("doc_id").alias("least")).join(found, ["anchor", "segment_id"], "left")
    return out.withColumn("windows", F.coalesce("windows", F.array().cast("array<int>")))


def _spread_spans(cut: DataFrame) -> DataFrame:
    """What _earlier() gives, by spread_windows()."""
    distinct = cut.groupBy("anchor", "segment_id").agg(F.min("doc_id").alias("doc_id"), F.first("segment").alias("segment"))
    rows = cut.select("anchor", "segment_id", "doc_id", "place", "size").join(spread_windows(distinct), ["anchor", "segment_id"])

    def span(begin: Column, end: Column) -> Column:
        return F.shiftleft(begin.cast("long"), 32) + end

    whole = F.array(span(F.col("place"), F.col("place") + F.col("size")))
    own = F.transform("windows", lambda w: span(F.col("place") + w, F.col("place") + w + LENGTH))
    return rows.select("doc_id", F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(own)).alias("span"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of documents (doc_id, text).

    A byte is removed if a 50-byte string over it also begins in a document with a smaller doc_id.
    A null text is empty and loses nothing. Of equal texts of at least 50 bytes all but the one with
    the smallest id lose everything. Rows that repeat a doc_id with one text get equal results; an id
    should not have several texts. Rows without a doc_id are compared with nothing and lose nothing.
    Further columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = written(docs.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("digest"),
        F.sha2("text", 256).alias("sha256"),
    ), "facts")
    known = facts.where(F.col("doc_id").isNotNull())
    first = written(known.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.first("digest").alias("digest")), "first")

    # Anchors that at least two different texts have, as places by text. Both readers of the shuffle ask for all
    # its columns, and nulls, of which there are none, are left out by name: so it is one and the same, made once.
    found = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    rows = found.select("text", "digest").mapInArrow(lean(_anchor_rows), "anchor long, digest long, place long")
    rows = rows.where("anchor is not null and digest is not null")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor")
    several = rows.groupBy("anchor").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("place").alias("n"))
    several = several.where("low <> high and n > 0").select("anchor")
    # Both sides are dealt by anchor already; the smaller one is hashed, so that nothing is sorted.
    places = rows.join(several.hint("shuffle_hash"), "anchor").groupBy("digest").agg(F.collect_set(F.struct("anchor", "place")).alias("places"))
    places = written(places.join(first, "digest").select(F.col("first").alias("doc_id"), F.col("digest").alias("of"), "places"), "places")
    # Places are those of one text; the comparison is no equality, so that the tables meet by doc_id alone.
    texts = docs.join(places, "doc_id").where(F.xxhash64("text").bitwiseXOR(F.col("of")) == 0).dropDuplicates(["doc_id"])

    # Segments of an anchor meet in one task, or string by string where they are too many for that.
    kinds = "anchor long, segment_id long, segment binary, doc_id long, place int, size int"
    cut = written(texts.select("doc_id", "text", "places").mapInArrow(lean(_segments), kinds), "cut")
    release(places)
    size = cut.groupBy("anchor").agg(F.sum("size").alias("bytes"))
    large = written(size.where(F.col("bytes") > ANCHOR_BYTES).select("anchor"), "large")
    blocks = cut.join(F.broadcast(large), "anchor", "left_anti")
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor").sortWithinPartitions("anchor")
    spans = blocks.mapInArrow(lean(_earlier), "doc_id long, span long")
    spans = written(spans.union(_spread_spans(cut.join(F.broadcast(large), "anchor"))), "spans")
    release(cut)

    by_doc = spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    lost = docs.join(by_doc, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "spans")
    lost = lost.mapInArrow(lean(_lost), "doc_id long, n_removed long, n_spans long, kept_sha256 string")

    copies = known.join(first.select("sha256", "first"), "sha256").where(f"doc_id > first and n_bytes >= {LENGTH}")
    copies = copies.select(
        "doc_id", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256")
    ).distinct()
    told = facts.drop("digest").join(lost.union(copies), "doc_id", "left")
    zero = F.lit(0).cast("long")
    return told.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
