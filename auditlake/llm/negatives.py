"""Hard negatives of anchors, searched along a spanning tree of the anchors.

Vectors are rounded to whole numbers, so scores, integer inner products, are exact. Anchors are a
stated set of queries; they are dealt to blocks of neighbours, rows to stripes, and a task meets one
block with the rows of one stripe, a batch at a time. Pairs of an anchor and a row are never rows.

A block holds a minimum spanning tree of its anchors. The root is scored with every row. If a row's
score at a parent lies in an interval, Cauchy's inequality puts its score at the child into that
interval widened by (length of the edge) x (length of the row). A row is scored again only where its
interval meets a window that the anchor still looks for: scores that may reach a slot's last place.
First the slots are an anchor's positives (same label, any score), then, for each positive, its
negatives (another label, scores in a window below the positive's).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.shared import small_batches, written

#: Anchors in a block (half as many to half more), least rows in a stripe, rows scored at once.
BLOCK, STRIPE, ROWS = 1024, 512, 1024
_FAR = 1 << 62
_SLOTS = "array<struct<id: long, score: long, low: long, high: long>>"
_FOUND = "anchor_id long, slot long, slot_score long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, units, size): components floor(scale * x), and the vector's length.

    Rows without id, label or vector, or with a component that is null or not finite, take no part;
    nor do vectors so long that a score might not fit 64 bits. Of rows with one id the one with the
    smallest label, then vector, counts.
    """
    x = F.col("embedding")
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(F.coalesce(sound, F.lit(False)))
    units = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), units.alias("units"))
    square = F.aggregate("units", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = rows.withColumn("size", F.sqrt(square)).where(F.col("size") < float(1 << 31))
    one = F.min(F.struct("label", "units", "size")).alias("one")
    return rows.groupBy("vec_id").agg(one).select("vec_id", "one.*")


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): the rows, parents first, and the edge of each to its parent.

    The tree is a minimum spanning tree by Prim's method; the first row is the root.
    """
    n = len(vectors)
    wide = vectors.astype(np.float64)
    square = (wide * wide).sum(1)
    order, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near = np.full(n, np.inf)
    outside = np.ones(n, bool)
    now = 0
    for k in range(n):
        order[k] = now
        outside[now] = False
        far = square + square[now] - 2 * (wide @ wide[now])
        closer = outside & (far < near)
        near[closer], parent[closer] = far[closer], now
        if k < n - 1:
            now = int(np.argmin(np.where(outside, near, np.inf)))
    # Lengths from differences: no digits cancel.
    length = np.sqrt(((wide - wide[parent]) ** 2).sum(1)) * (1 + 1e-12)
    return order, parent, length


class Block:
    """Anchors of a block and what their slots hold so far."""

    def __init__(self, ids, labels, vectors: np.ndarray, slots: list[list[dict]], same: bool, most: int):
        self.ids, self.labels, self.vectors, self.same, self.most = ids, labels, vectors, same, most
        self.order, self.parent, self.length = spanning_tree(vectors)
        self.slots = slots
        self.low = [np.array([s["low"] for s in own], np.float64) for own in slots]
        self.high = [np.array([s["high"] for s in own], np.float64) for own in slots]
        self.held = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own] for own in slots]
        self.least = [x.copy() for x in self.low]
        self.scored = 0

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, sizes: np.ndarray) -> None:
        """Searches some rows for all anchors."""
        width = max(vectors.shape[1], self.vectors.shape[1])
        if self.vectors.shape[1] < width:
            self.vectors = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))
        vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        # Below 2 ** 53 every partial sum is a whole number that floating point holds exactly.
        most = sizes.max(initial=0) * np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1)).max(initial=0)
        kind = np.float64 if most < 1 << 52 else np.int64
        anchors, rows = self.vectors.astype(kind), vectors.astype(kind)
        low, high = np.empty((len(anchors), len(ids))), np.empty((len(anchors), len(ids)))
        for k, a in enumerate(self.order.tolist()):
            wanted = (labels == self.labels[a]) == self.same
            if self.same:
                wanted &= ids != self.ids[a]
            if k == 0:
                again = np.arange(len(ids))
            else:
                reach = sizes * self.length[a] * (1 + 1e-12) + 1
                low[a], high[a] = low[self.parent[a]] - reach, high[self.parent[a]] + reach
                meets = np.zeros(len(ids), bool)
                for least, top in zip(self.least[a], self.high[a]):
                    meets |= (high[a] >= least) & (low[a] <= top)
                again = np.flatnonzero(wanted & meets)
            if not len(again):
                continue
            score = (rows[again] if k else rows) @ anchors[a]
            low[a, again] = high[a, again] = score
            # A score above 2 ** 53 may be rounded in its interval.
            if kind is np.int64:
                low[a, again] -= 4096
                high[a, again] += 4096
            self.scored += len(again)
            keep = wanted[again]
            self._offer(a, ids[again][keep], score[keep].astype(np.int64))

    def _offer(self, a: int, ids: np.ndarray, score: np.ndarray) -> None:
        for k, slot in enumerate(self.slots[a]):
            fits = (score >= slot["low"]) & (score <= slot["high"])
            if not fits.any():
                continue
            held_ids, held = self.held[a][k]
            held_ids, held = np.concatenate((held_ids, ids[fits])), np.concatenate((held, score[fits]))
            first = np.lexsort((held_ids, -held))[: self.most]
            self.held[a][k] = held_ids[first], held[first]
            if len(first) == self.most:
                self.least[a][k] = max(self.least[a][k], float(held[first[-1]]) - (0 if abs(held[first[-1]]) < 1 << 52 else 4096))

    def found(self) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(5)]
        for a, own in enumerate(self.slots):
            for slot, (ids, score) in zip(own, self.held[a]):
                for column, value in zip(columns, ([self.ids[a]] * len(ids), [slot["id"]] * len(ids), [slot["score"]] * len(ids), ids, score)):
                    column.extend(value)
        names = [f.split()[0] for f in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones ending in zeros."""
    size = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy()
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _search(same: bool, most: int):
    """Rows by (block, stripe), anchors first -> what the slots of each anchor hold after the stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, anchors = None, None, []

        def opened() -> Block:
            rows = pa.Table.from_batches(anchors).combine_chunks()
            ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            units = rows.column("units").combine_chunks()
            return Block(ids, labels, _matrix(units), rows.column("slots").to_pylist(), same, most)

        for batch in batches:
            of = np.stack([batch.column(c).to_numpy() for c in ("block", "stripe")])
            kind = batch.column("kind").to_numpy()
            edge = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if low == high:
                    continue
                part, now = batch.slice(low, high - low), tuple(of[:, low].tolist())
                if now != key:
                    if block:
                        yield block.found()
                    key, block, anchors = now, None, []
                if kind[low] == 0:
                    anchors.append(part)
                    continue
                if block is None and not anchors:
                    continue  # no anchor of the block looks for anything
                if block is None:
                    block = opened()
                ids, labels, size = (part.column(c).to_numpy() for c in ("vec_id", "label", "size"))
                block.meet(ids, labels, _matrix(part.column("units")), size)
        if block:
            yield block.found()

    return run


def dealt_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """`anchors` (n of them) with the number of their `block`: neighbours by the signs of some fixed projections.

    Cells of about BLOCK anchors come from as many projections as that takes; a cell that holds
    more is divided by a hash.
    """
    bits = max(0, (n // BLOCK).bit_length() - 1)
    cell = F.lit(0).cast("long")
    for k in range(bits):
        signed = F.transform("units", lambda v, i: F.when(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(2)) == 0, v).otherwise(-v).cast("double"))
        cell = cell * 2 + F.when(F.aggregate(signed, F.lit(0.0), lambda a, v: a + v) > 0, 1).otherwise(0)
    celled = anchors.withColumn("cell", cell)
    parts = celled.groupBy("cell").agg(F.greatest(F.round(F.count("*") / BLOCK), F.lit(1)).cast("long").alias("parts"))
    dealt = written(celled.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")), "dealt")
    # One row for about BLOCK anchors is numbered.
    number = F.row_number().over(Window.orderBy("cell", "part")) - 1
    numbered = dealt.select("cell", "part").distinct().withColumn("block", number.cast("long"))
    return dealt.join(numbered, ["cell", "part"]).drop("cell", "part", "parts")


def slot_tops(rows: DataFrame, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """(anchor_id, slot, slot_score, vec_id, score, rank): the first `most` rows of each anchor's slots.

    `rows` are whole_vectors(); `anchors` have `block` and `slots` besides. With `same`, rows of the
    anchor's label but itself are searched, otherwise rows of other labels.
    """
    spark = rows.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, n = anchors.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0], rows.count()
    stripes = max(1, min(-(-parts // max(blocks, 1)), -(-n // STRIPE)))
    whole = F.array(*(F.lit(k).cast("long") for k in range(stripes)))
    query = anchors.select("block", F.explode(whole).alias("stripe"), F.lit(0).alias("kind"), "vec_id", "label", "units", "size", "slots")
    # Every row goes to every block of the stated queries.
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")) if blocks else F.array().cast("array<long>")
    other = rows.select(
        F.explode(every).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(stripes)).alias("stripe"), F.lit(1).alias("kind"),
        "vec_id", "label", "units", "size", F.lit(None).cast(_SLOTS).alias("slots"),
    )
    dealt = query.unionByName(other).repartition(parts, "block", "stripe").sortWithinPartitions("block", "stripe", "kind")
    found = dealt.mapInArrow(_search(same, most), _FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `vectors` has vec_id, label and embedding; rows with `is_anchor` are the anchors. A score is the
    inner product of whole_vectors(), a shorter vector ending in zeros. An anchor's positives are its
    first rows of the same label, itself left out; the negatives of a positive are the first rows of
    other labels whose score lies within `window` percent of the positive's. Higher scores come
    first, ties by smaller vec_id; all there are count if there are fewer. Rows that whole_vectors()
    leaves out take no part, repeated ids count once, further columns are ignored, and a table
    without anchors gives an empty table.
    """
    rows = written(whole_vectors(vectors, scale), "vectors")
    anchors = rows.where(is_anchor)
    anchors = written(dealt_blocks(anchors, anchors.count()), "anchors")
    any_score = F.struct(F.lit(0).alias("id"), F.lit(0).alias("score"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"))
    near = slot_tops(rows, anchors.withColumn("slots", F.array(any_score).cast(_SLOTS)), True, positives)
    exact = F.col("score").cast("decimal(20,0)")
    slot = F.struct(
        F.col("vec_id").alias("id"), "score", F.ceil(exact * window[0] / 100).cast("long").alias("low"),
        F.floor(exact * window[1] / 100).cast("long").alias("high"),
    )
    slots = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(slot)).cast(_SLOTS).alias("slots"))
    asking = written(anchors.join(slots.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "asking")
    hard = slot_tops(rows, asking, False, negatives)
    return hard.select(
        "anchor_id", F.col("slot").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("slot_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
