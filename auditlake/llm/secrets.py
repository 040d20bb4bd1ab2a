"""Secrets in texts: fixed patterns, and random-looking strings by two character Markov models.

One scan of the texts yields the pattern matches, every run of 16 or more token characters with
its place, and counts of character pairs over all texts: those inside pattern matches are labelled
random, all others ordinary. The summed counts (a table of fixed size) and a set of generated
random strings train two first-order models. A run is reported if the logarithm of its likelihood
ratio, random against ordinary, is high in total and for each character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import lean, small_batches, written
from auditlake.llm.texts import LOWER, pieces, text_bytes

#: The patterns and how long a match has to be.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ["assign", "access", "hex", "random"]

_WORDS = [b"password", b"passwd", b"secret", b"token", b"api"]
_TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(_TOKEN) + 1  # 0 is any other character
_CLASS = np.zeros(256, np.int64)
_CLASS[list(_TOKEN.encode())] = np.arange(1, _SIZE)

#: Bytes of text scanned together: a worker holds about a hundred bytes for each, beside the executor's JVM.
CHUNK = 1 << 18

#: Runs from this length on are scored; a random one reaches both bounds (natural logarithms).
LEAST_RUN, LEAST_TOTAL, LEAST_MEAN = 16, 20.0, 0.7
#: Generated random strings: so many of 32 characters from each alphabet.
GENERATED = 500
ALPHABETS = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", _TOKEN[:62], _TOKEN[:64]]

SCAN = (
    "doc_id long, base array<struct<kind:int,start:long,end:long>>, "
    "runs array<struct<start:long,end:long,run:string>>, pairs array<struct<pair:int,labelled:long,ordinary:long>>"
)
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("run", pa.string())]))
_PAIR = pa.list_(pa.struct([("pair", pa.int32()), ("labelled", pa.int64()), ("ordinary", pa.int64())]))
_COLUMNS = ["doc_id", "base", "runs", "pairs"]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of every pattern match, by start, then kind."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(found, key=lambda x: (x[1], x[0]))


def pair_counts(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring character classes, with an edge before and after each text."""
    data, at = text_bytes(pa.array(texts, pa.string()))
    return _pairs(_CLASS[data], at)


def _pairs(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.zeros(len(kind), np.int64)
    before[1:] = kind[:-1]
    full = at[1:] > at[:-1]
    before[at[:-1][full]] = 0
    last = kind[at[1:][full] - 1] * _SIZE
    return np.bincount(before * _SIZE + kind, minlength=_SIZE**2) + np.bincount(last, minlength=_SIZE**2)


def piece_spans(column: pa.Array) -> tuple[list, list, list[str], np.ndarray]:
    """For the texts of a piece: pattern matches, long runs, the matched secrets, ordinary pairs."""
    data, at = text_bytes(column)
    kind = _CLASS[data]
    low = LOWER[data].tobytes()
    # Code points before each byte; runs never cross a text as the edges break them.
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    token = np.zeros(len(data) + 2, bool)
    token[1:-1] = kind > 0
    first = token[1:-1] & ~token[:-2]
    last = token[1:-1] & ~token[2:]
    edge = at[(at > 0) & (at < len(data))]
    first[edge] = token[1:-1][edge]
    last[edge - 1] = token[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long_ = end - start >= LEAST_RUN
    start, end = start[long_], end[long_]
    of = np.searchsorted(at, start, "right") - 1
    inside = np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    ordinary = _pairs(np.where(np.cumsum(inside)[:-1] > 0, 0, kind), at)
    runs, bases, secrets = [[] for _ in range(len(at) - 1)], [], []
    for s, e, k in zip(start.tolist(), end.tolist(), of.tolist()):
        shift = points[at[k]]
        runs[k].append((int(points[s] - shift), int(points[e] - shift), data[s:e].tobytes().decode()))
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        # A long match of "access" or "hex" lies in a run; "assign" needs one of its words.
        found = base_spans(column[k].as_py()) if runs[k] or any(low.find(w, a, b) >= 0 for w in _WORDS) else []
        secrets += [x[3] for x in found]
        bases.append([x[:3] for x in found])
    return bases, runs, secrets, ordinary


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordinary, labelled = np.zeros(_SIZE**2, np.int64), np.zeros(_SIZE**2, np.int64)
    for batch in pieces(batches, "text", CHUNK):
        bases, runs, secrets, pairs = piece_spans(batch.column("text"))
        ordinary += pairs
        labelled += pair_counts(secrets)
        yield _rows(batch.column("doc_id"), bases, runs, [None] * len(bases))
    pairs = [(k, int(labelled[k]), int(ordinary[k])) for k in np.flatnonzero(labelled + ordinary).tolist()]
    if pairs:
        yield _rows(pa.array([None], pa.int64()), [None], [None], [pairs])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a scan alone."""
    for batch in _scan(batches):
        if batch.column("pairs").null_count < batch.num_rows:
            yield batch.select(["pairs"])


def _rows(ids: pa.Array, bases: list, runs: list, pairs: list) -> pa.RecordBatch:
    def spans(rows: list, kind: pa.DataType) -> pa.Array:
        names = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
        return pa.array([None if row is None else [dict(zip(names, x)) for x in row] for row in rows], kind)

    return pa.RecordBatch.from_arrays([ids, spans(bases, _SPAN), spans(runs, _RUN), spans(pairs, _PAIR)], _COLUMNS)


def generated_strings() -> list[str]:
    """Labelled random strings, the same in every run."""
    rng = np.random.default_rng(11)
    return ["".join(rng.choice(list(a), 32)) for a in ALPHABETS for _ in range(GENERATED)]


def log_ratios(labelled: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(next | before, random) - log P(next | before, ordinary), with add-one smoothing."""
    random = labelled + pair_counts(generated_strings())
    models = []
    for counts in (random, ordinary):
        table = counts.reshape(_SIZE, _SIZE) + 1.0
        models.append(np.log(table / table.sum(1, keepdims=True)))
    return models[0] - models[1]


def train(scan: DataFrame) -> np.ndarray:
    """The table of log ratios; only sums, at most one row for each pair of classes, are collected."""
    pair = scan.where("pairs is not null").select(F.inline("pairs"))
    rows = pair.groupBy("pair").agg(F.sum("labelled").alias("labelled"), F.sum("ordinary").alias("ordinary")).collect()
    labelled, ordinary = np.zeros(_SIZE**2, np.int64), np.zeros(_SIZE**2, np.int64)
    for r in rows:
        labelled[r.pair], ordinary[r.pair] = r.labelled, r.ordinary
    return log_ratios(labelled, ordinary)


def run_score(run: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio of a run with both its edges."""
    kind = _CLASS[np.frombuffer(run.encode(), np.uint8)]
    return float(ratio[np.append(0, kind), np.append(kind, 0)].sum())


def is_random(run: str, ratio: np.ndarray) -> bool:
    score = run_score(run, ratio)
    return score >= LEAST_TOTAL and score >= LEAST_MEAN * len(run) and not run.isdigit()


def _all_spans(base: list[tuple], runs: list[tuple], ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of pattern matches and of the random runs that overlap none of them."""
    added = [
        (3, start, end) for start, end, run in runs
        if all(end <= b[1] or b[2] <= start for b in base) and is_random(run, ratio)
    ]
    return sorted(base + added, key=lambda x: (x[1], x[0]))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and `spans` (kind, start, end; by start, then kind) for every row of (doc_id, text).

    Kinds are those of KINDS; start and end count code points, end is exclusive. A random run is
    added only where it overlaps no pattern match. A null or empty text has no spans. Repeated
    rows get equal results, a null doc_id stays null, further columns are ignored, and an empty
    table gives an empty table. Without any text the models are those of the generated strings.
    """
    small_batches(docs.sparkSession)
    scan = written(docs.select("doc_id", "text").mapInArrow(lean(_scan), SCAN), "scan")
    ratio = train(scan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _all_spans([tuple(b.values()) for b in base], [tuple(r.values()) for r in runs], ratio)
                for base, runs in zip(batch.column("base").to_pylist(), batch.column("runs").to_pylist())
            ]
            out = [[dict(zip(("kind", "start", "end"), x)) for x in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPAN)], ["doc_id", "spans"])

    rows = scan.where("pairs is null").select("doc_id", "base", "runs")
    return rows.mapInArrow(lean(run), "doc_id long, spans array<struct<kind:int,start:long,end:long>>")


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts of the pattern matches, the digest of their places and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def joined(column):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)))

    base = F.filter("spans", lambda s: s.kind < 3)
    kinds = F.transform("spans", lambda s: s.kind)
    count = {f"n_{k}": F.size(F.filter(kinds, lambda x: x == F.lit(i))).cast("long") for i, k in enumerate(KINDS)}
    return spans.select(
        "doc_id", *(c.alias(k) for k, c in count.items()), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def without_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """`docs` with every secret in `text` masked and n_chars, where there is one, counted anew."""
    small_batches(docs.sparkSession)
    pairs = docs.select("doc_id", "text").mapInArrow(lean(_pair_rows), "pairs array<struct<pair:int,labelled:long,ordinary:long>>")
    ratio = train(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            bases, runs, _, _ = piece_spans(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for k, (base, found) in enumerate(zip(bases, runs)):
                if base or found:
                    texts[k] = masked(texts[k], [x[1:] for x in _all_spans(base, found, ratio)], mask)
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def masked(text: str | None, spans: list[tuple[int, int]], mask: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones together, replaced by `mask`."""
    if not spans:
        return text
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]
