"""Language identification: averaged hashed subword embeddings with a linear softmax.

Features of a text are the byte 2-, 3- and 4-grams of its words (A-Z lower-cased, a blank before
and after each word), hashed to rows of an embedding table. A text is the average of its rows; a
linear layer and a softmax give the probabilities. Embedding and layer are trained together by
stochastic gradient descent on a bounded sample. As the layer is linear, prediction averages the
rows of (embedding x layer), a small table, over whole texts. A temperature fitted on texts that
training has not seen calibrates the probabilities, and the rejection bound is read off there too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import lean, small_batches, trim, written
from auditlake.llm.texts import CHUNK_BYTES, LOWER, SPACE, pieces, text_bytes

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
UNKNOWN = "und"

#: Bounds of the training sample: about so many rows of the table, of these so many for each
#: language and so many bytes of text in all.
SAMPLE_ROWS, LANGUAGE_ROWS, TRAIN_BYTES = 12_000, 1_500, 12 << 20


@dataclass(frozen=True)
class Training:
    """Settings of the gradient descent; every fifth text only calibrates."""

    size: int = 16
    epochs: int = 6
    batch: int = 32
    rate: float = 0.5
    held: int = 5
    #: Share of calibration texts, predicted rightly, that the rejection bound may cost.
    lost: float = 0.001
    #: The bound is never above this probability.
    bound: float = 0.5
    seed: int = 23


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times layer
    bias: np.ndarray
    temperature: float
    bound: float


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one array of BUCKETS indices for each n, with text offsets.

    An edge blank before and after each text keeps n-grams inside texts; runs of blanks count as
    one blank as n-grams that hold a blank elsewhere than at their ends are left out.
    """
    n = len(at) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = LOWER[data]
    starts = at[:-1] + np.arange(n)
    out = np.concatenate(([32], out)).astype(np.uint32)
    blank = SPACE[out.astype(np.uint8)]
    out[blank] = 32
    found, owner = [], []
    for size in GRAMS:
        m = len(out) - size + 1
        if m <= 0:
            continue
        code = np.full(m, size, np.uint32)
        inner = np.zeros(m, bool)
        for k in range(size):
            code = code * np.uint32(0x01000193) + out[k : k + m]
            if 0 < k < size - 1:
                inner |= blank[k : k + m]
        both = blank[:m] & blank[size - 1 : size - 1 + m]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        kept = np.flatnonzero(~(inner | both))
        found.append((code[kept] >> np.uint32(16)).astype(np.int64))
        owner.append(np.searchsorted(kept, np.append(starts, len(out))))
    return found, owner


def _sums(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's features, and their number."""
    n = len(at) - 1
    total, count = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    for index, of in zip(*features(data, at)):
        full = np.flatnonzero(of[1:] > of[:-1])
        if len(full):
            total[full] += np.add.reduceat(table[index], of[:-1][full], axis=0)
            count += np.diff(of)
    return total, count


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def fit(texts: list[str], languages: list[str], training: Training = Training()) -> Model:
    """Trains on (text, language) pairs; their order does not matter."""
    pairs = sorted({(t, l) for t, l in zip(texts, languages) if has_letter(t)})
    names = sorted({l for _, l in pairs})
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(training.seed)
    order = rng.permutation(len(pairs))
    bags, wanted = [], []
    for i in order:
        found, _ = features(*text_bytes(pa.array([pairs[i][0]])))
        index, count = np.unique(np.concatenate(found), return_counts=True)
        bags.append((index.astype(np.int32), (count / count.sum()).astype(np.float32)))
        wanted.append(names.index(pairs[i][1]))
    wanted = np.array(wanted)
    held = np.arange(len(bags)) % training.held == training.held - 1
    rows, check = np.flatnonzero(~held), np.flatnonzero(held)
    embedding = rng.uniform(-1, 1, (BUCKETS, training.size)) / training.size
    layer, bias = np.zeros((training.size, len(names))), np.zeros(len(names))
    steps, done = training.epochs * max(1, -(-len(rows) // training.batch)), 0
    for _ in range(training.epochs):
        shuffled = rng.permutation(rows)
        for low in range(0, len(shuffled), training.batch):
            part = shuffled[low : low + training.batch]
            rate = training.rate * (1 - done / steps)
            done += 1
            hidden = np.stack([w @ embedding[i] for i, w in (bags[k] for k in part)])
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(part)), wanted[part]] -= 1
            back = error @ layer.T
            layer -= rate * hidden.T @ error
            bias -= rate * error.mean(0)
            # A feature is a small share of a text's average: its step is scaled up by the share,
            # so that one text's average moves by the mean of the batch's steps at most.
            for k, g in zip(part, back):
                index, weight = bags[k]
                scale = min(300.0, 1 / float(weight @ weight)) / len(part)
                embedding[index] -= rate * scale * weight[:, None] * g[None]
    table = embedding @ layer
    check = check if len(check) else rows
    logits = np.stack([bags[k][1] @ table[bags[k][0]] for k in check]) + bias
    temperature = min(np.geomspace(0.05, 5000, 120), key=lambda t: _loss(logits / t, wanted[check]))
    chance = _softmax(logits / temperature)
    right = chance.argmax(1) == wanted[check]
    sure = np.sort(chance.max(1)[right])
    bound = sure[int(training.lost * len(sure))] if len(sure) else 0.0
    return Model(names, table, bias, float(temperature), float(min(bound * 0.999, training.bound)))


def _loss(logits: np.ndarray, wanted: np.ndarray) -> float:
    return float(-np.log(_softmax(logits)[np.arange(len(wanted)), wanted] + 1e-12).mean())


def sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS labelled rows (lang, place, text), chosen by a hash of the id."""
    rows = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id").alias("place"), "text")
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    return rows.where(F.pmod("place", F.lit(1 << 20)) < F.lit(share * (1 << 20)))


def train(docs: DataFrame, training: Training = Training()) -> Model:
    """Fits a model on a bounded sample of `docs` (doc_id, text, lang)."""
    chosen = written(sample(docs), "sample")
    sizes = chosen.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    limit, room = F.lit(0.0), TRAIN_BYTES / max(1, len(sizes))
    for r in sizes:
        share = min(1.0, LANGUAGE_ROWS / r.n, room / max(1, r.bytes))
        limit = F.when(F.col("lang") == r.lang, F.lit(share)).otherwise(limit)
    rows = chosen.where(F.pmod(F.shiftright("place", 20), F.lit(1 << 20)) < limit * (1 << 20)).select("text", "lang").collect()
    model = fit([r.text for r in rows], [r.lang for r in rows], training)
    del rows
    trim()
    return model


def predictions(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and rejection of each text."""
    data, at = text_bytes(texts)
    letter = (data >= 65) & (data <= 122) & ((data <= 90) | (data >= 97))
    sums = np.concatenate(([0], np.cumsum(letter)))
    known = sums[at[1:]] > sums[at[:-1]]
    for k in np.flatnonzero(~known):
        known[k] = has_letter(texts[k].as_py())
    n = len(at) - 1
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    total, count = _sums(model.table, data, at)
    chance = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    best = chance.argmax(1)
    score = np.where(known, chance.max(1), 0.0)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return names, score, ~known | (score < model.bound)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of documents (doc_id, text).

    The prediction depends on the text alone. A text that is null or has no letter is `und` with
    score 0 and rejected; so is every text if there was nothing to learn from. Other texts get one of the
    learned languages with its calibrated probability and are rejected below the model's bound.
    Repeated rows get equal results, further columns are ignored, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK_BYTES // 2):
            names, score, rejected = predictions(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the model does not reject, with all their columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK_BYTES // 2):
            yield batch.filter(pa.array(~predictions(model, batch.column("text"))[2]))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
