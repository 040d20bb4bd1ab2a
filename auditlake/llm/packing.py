"""Token ids of texts, packed into rows of equal length by best fit decreasing.

A task encodes its texts and packs blocks of about BLOCK_TOKENS ids. Longer documents are cut into
whole rows and a rest, so nothing is lost. Pieces go by decreasing length into the fullest row that
still holds them; a segment tree over free capacities finds it in logarithmic time. A row carries
its ids, where its segments begin (cumulative lengths), positions that restart at 0 with each
segment, and of each segment the document and the place of its first id there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import small_batches

BLOCK_TOKENS = 1 << 21

PACKED = (
    "ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, n_ids int"
)


class Capacities:
    """Rows by free capacity, 0 to `size`; finds the smallest capacity of at least n that a row has."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._count(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the best fit for n, or None."""
        at = n + self.leaves
        while not self.tree[at]:
            while at & 1:  # a right child: go up until there is something to the right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.tree[at]:
                at += 1
        capacity = at - self.leaves
        self._count(capacity, -1)
        return capacity, self.rows[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of piece indices, by best fit decreasing; every length is 1 to `size`."""
    free, rows = Capacities(size), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = free.take(n)
        if found is None:
            found = size, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(k)
        if capacity > n:
            free.add(capacity - n, row)
    return rows


def packed(ids: list[np.ndarray], doc_ids: list, size: int, pad: int) -> pa.RecordBatch:
    """Rows of PACKED for the ids of some documents."""
    pieces = [(k, low, min(low + size, len(x))) for k, x in enumerate(ids) for low in range(0, len(x), size)]
    lengths = np.array([high - low for _, low, high in pieces], np.int64)
    columns: list[list] = [[] for _ in range(6)]
    for row in best_fit(lengths, size):
        line, place = np.full(size, pad, "<i4"), np.zeros(size, "<i4")
        bounds = np.concatenate(([0], np.cumsum(lengths[row])))
        for p, at in zip(row, bounds.tolist()):
            k, low, high = pieces[p]
            line[at : at + high - low] = ids[k][low:high]
            place[at : at + high - low] = np.arange(high - low)
        told = (
            line.tobytes(), place.tobytes(), bounds.astype(np.int32), [doc_ids[pieces[p][0]] for p in row],
            [pieces[p][1] for p in row], int(bounds[-1]),
        )
        for column, value in zip(columns, told):
            column.append(value)
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
    names = [f.strip().split()[0] for f in PACKED.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


@cache
def encoder(path: str, pattern: str):
    """A byte-level encoder from a file of ranks (base64 token, rank)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def packed_ids(docs: DataFrame, path: str, pattern: str, size: int = 2048, end: int = 50256, pad: int = 50256) -> DataFrame:
    """Packed rows of `size` ids (PACKED) for documents (doc_id, text).

    Ids are those of the ranks in `path`, which every executor reads, with `end` after each
    document. A null or empty text has no ids and is in no row. Rows that repeat a doc_id are packed
    as documents of their own, a null doc_id stays null, further columns are ignored, and an empty
    table gives an empty table. The ids of a document are its segments in the order of `starts`.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ids, of, total = encoder(path, pattern), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if not (text := text.as_py()):
                    continue
                found = np.append(encode.encode_to_numpy(text, disallowed_special=()), end)
                ids.append(found)
                of.append(doc_id)
                total += len(found)
                if total >= BLOCK_TOKENS:
                    yield packed(ids, of, size, pad)
                    ids, of, total = [], [], 0
        if ids:
            yield packed(ids, of, size, pad)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def write_packed(rows: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet; `ids` of a file, one after another, are its id matrix."""
    rows.write.parquet(path)


def id_matrix(rows: pa.Table, size: int, column: str = "ids") -> np.ndarray:
    """The id (or position) matrix of some packed rows."""
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), "<i4").reshape(-1, size)


def row_digest(rows: DataFrame) -> DataFrame:
    """Packed rows with digests in place of ids and positions."""
    return rows.select(
        "doc_ids", "starts", "cu_seqlens", "n_ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )
