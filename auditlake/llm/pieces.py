"""Encoding with a SentencePiece BPE model under seeded merge-dropout, and lossless decoding.

A unit is a run of blanks with the word after it; no piece crosses units. Inside a unit an agenda
gives the candidate merges by score, leftmost first. A candidate that comes up is skipped if a hash
of the seed, the text's variant, the unit, the place and the resulting piece falls below the dropout
rate. The same unit of one variant is therefore always cut the same way, different variants differ,
and reruns agree. Without dropout the result is the model's own encoding.

The agendas of all different units of a piece of the table run side by side: each round takes the
best candidate of every unit and skips or merges it. Units longer than LONG characters, where
rounds would be many, have an agenda of their own, a heap, with the same results.

Bytes decode exactly: a character that is no piece is written as its bytes, and so is U+2581, which
stands for a blank inside pieces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import lean, small_batches
from auditlake.llm.texts import _INVERSE, _PRIME, _power, mixed, pieces, text_bytes

BLANK = 0x2581
LONG = 48
#: Bytes of text cut together: a worker holds some hundred bytes for each, beside the executor's JVM.
CHUNK = 1 << 18
KEPT = 400_000
_FAR = np.int64(1) << 40
_MASK = (1 << 64) - 1


class MergeTable:
    """Rank and result of each pair of symbols that merges, in a table of hashed places.

    A key lies at its place or in the run of keys after it.
    """

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 21) + b for a, b in merges], np.int64)
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        room = (1 << (64 - int(self.shift))) + len(keys) + 1
        self.keys, self.ranks, self.into = np.full(room, -1), np.full(room, _FAR), np.zeros(room, np.int64)
        for at, k, (rank, into) in zip(self._place(keys).tolist(), keys.tolist(), merges.values()):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at], self.into[at] = k, rank, into

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(_PRIME)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each merge; rank _FAR where there is none."""
        key = (left << 21) + right
        at = self._place(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] += 1
            have = self.keys[at[open_]]
            open_ = open_[(have != key[open_]) & (have >= 0)]
        # An empty place has rank _FAR.
        return self.ranks[at], self.into[at]


class Model(MergeTable):
    """Pieces, scores and byte pieces of a model file, as tables over symbols.

    Symbols 0.. are the model's pieces; further ones are characters that are no piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        ids = {t: i for i, t in text.items()}
        self.size = size
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # Lower ranks merge first; equal scores have equal ranks.
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        self.symbol = {t: i for t, i in ids.items() if len(t) == 1}
        extra = sorted({c for t in ids for c in t} - set(self.symbol))
        self.symbol |= {c: size + k for k, c in enumerate(extra)}
        known = ids | self.symbol
        self.merges = {}
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = known.get(t[:k]), known.get(t[k:])
                if a is not None and b is not None:
                    self.merges[a, b] = (rank_of[model.get_score(i)], i)
        self.first_unknown = size + len(extra)
        self.known = Known()
        super().__init__(self.merges)
        chars = sorted(self.symbol)
        self.chars = np.array([ord(c) for c in chars], np.int64)
        self.char_symbols = np.array([self.symbol[c] for c in chars], np.int64)
        told = [b""] * size
        for i, t in text.items():
            told[i] = t.replace(chr(BLANK), " ").encode()
        for b in range(256):
            told[self.byte[b]] = bytes([b])
        self.told = np.frombuffer(b"".join(told), np.uint8)
        self.told_at = np.concatenate(([0], np.cumsum([len(t) for t in told])))

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """A symbol for each code point; those without one are told apart but merge with nothing."""
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, self.char_symbols[at], self.first_unknown + points)


@cache
def load(path: str) -> Model:
    return Model(path)


def _skips(unit_key: np.ndarray, place: np.ndarray, into: np.ndarray, dropout: float) -> np.ndarray:
    draw = mixed(unit_key ^ mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + into.astype(np.uint64)))
    return (draw >> np.uint64(11)).astype(np.float64) < dropout * float(1 << 53)


def agenda(model: Model, symbols: list[int], unit_key: int, dropout: float) -> list[int]:
    """One unit by a heap of candidate merges."""
    n = len(symbols)
    now, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []
    key = np.array([unit_key], np.uint64)

    def add(i: int) -> None:
        j = after[i] if 0 <= i else n
        if 0 <= i and j < n and (found := model.merges.get((now[i], now[j]))):
            heapq.heappush(heap, (found[0], i, now[i], now[j], j, found[1]))

    for i in range(n):
        add(i)
    while heap:
        _, i, a, b, j, into = heapq.heappop(heap)
        if now[i] != a or after[i] != j or now[j] != b:
            continue
        if dropout and _skips(key, np.array([i]), np.array([into]), dropout)[0]:
            continue
        now[i], now[j], after[i] = into, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        add(before[i])
        add(i)
    out, i = [], 0
    while i < n:
        out.append(now[i])
        i = after[i]
    return out


def rounds(model: MergeTable, symbols: np.ndarray, first: np.ndarray, unit_key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Many units side by side: final symbols of all units in order, and their number in each.

    `first` holds the n + 1 offsets of the units in `symbols`.
    """
    count = np.diff(first)
    unit = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(symbols)) - first[unit]
    now = symbols.copy()
    rank, into = np.full(len(now), _FAR), np.zeros(len(now), np.int64)
    inner = np.flatnonzero(unit[1:] == unit[:-1]) if len(now) else np.zeros(0, np.int64)
    rank[inner], into[inner] = model.lookup(now[inner], now[inner + 1])
    done_symbols, done_units, done_places = [], [], []
    while len(now):
        head = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.minimum.reduceat(rank * 256 + place, head)
        live = best < _FAR * 256
        if not live.all():
            sizes = np.diff(np.append(head, len(now)))
            stay = np.repeat(live, sizes)
            for held, x in ((done_symbols, now), (done_units, unit), (done_places, place)):
                held.append(x[~stay])
            now, unit, place, rank, into = (x[stay] for x in (now, unit, place, rank, into))
            best, sizes = best[live], sizes[live]
            if not len(now):
                break
            head = np.cumsum(sizes) - sizes
        sizes = np.diff(np.append(head, len(now)))
        chosen = np.flatnonzero(rank * 256 + place == np.repeat(best, sizes))
        skip = _skips(unit_key[unit[chosen]], place[chosen], into[chosen], dropout) if dropout else np.zeros(len(chosen), bool)
        rank[chosen[skip]] = _FAR
        merged = chosen[~skip]
        now[merged] = into[merged]
        keep = np.ones(len(now), bool)
        keep[merged + 1] = False
        at = np.cumsum(keep) - 1
        now, unit, place, rank, into = (x[keep] for x in (now, unit, place, rank, into))
        merged = at[merged]
        near = np.zeros(len(now), bool)
        near[merged] = True
        near[np.maximum(merged - 1, 0)] = True
        fresh = np.flatnonzero(near)
        nxt = np.minimum(fresh + 1, len(now) - 1)
        inside = (nxt > fresh) & (unit[nxt] == unit[fresh])
        rank[fresh], into[fresh] = model.lookup(now[fresh], now[nxt])
        rank[fresh[~inside]] = _FAR
        # A pair left of a merge is a new candidate; one skipped before stays skipped if unchanged.
    if not done_units:
        return np.zeros(0, np.int64), np.zeros(len(count), np.int64)
    now, unit, place = (np.concatenate(x) for x in (done_symbols, done_units, done_places))
    order = np.lexsort((place, unit))
    return now[order], np.bincount(unit, minlength=len(count))


def encode(model: Model, data: np.ndarray, at: np.ndarray, variant: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after another, and the n + 1 offsets of the texts."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    first = lead[at]
    full = np.flatnonzero(np.diff(first) > 0)
    n = len(at) - 1
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    points = np.where(points == 32, BLANK, np.where(points == BLANK, -1, points))
    points = np.insert(points, first[full], BLANK)
    begin = first[full] + np.arange(len(full))
    blank = points == BLANK
    symbols = np.where(points == -1, model.first_unknown + BLANK, model.symbols(points))
    new = blank.copy()
    new[1:] &= ~blank[:-1]
    new[begin] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(points)))
    text = full[np.searchsorted(begin, start, "right") - 1]

    # Different units of each variant, by hash.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(symbols.astype(np.uint64)) * _power(_PRIME, len(symbols)))))
    hashed = (sums[start + size] - sums[start]) * _power(_INVERSE, len(symbols) + 1)[start]
    salt = mixed(np.array([seed & _MASK], np.uint64))[0]
    key = mixed(hashed + size.astype(np.uint64) + mixed(variant[text].astype(np.uint64) + salt))
    key, one, of = np.unique(key, return_index=True, return_inverse=True)
    final, offsets, counts = model.known.resolve(
        (str(seed), dropout), key, lambda new: _cut(model, symbols, start[one[new]], size[one[new]], key[new], dropout)
    )
    take = counts[of]
    where = np.repeat(offsets[of] - np.cumsum(take) + take, take) + np.arange(take.sum())
    return _as_ids(model, final[where].astype(np.int64), np.bincount(text, take, minlength=n).astype(np.int64))


def _cut(model: Model, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of units, one after another, and their numbers."""
    short = size <= LONG
    lengths = size[short]
    inside = np.repeat(start[short] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    final, count = rounds(model, symbols[inside], np.concatenate(([0], np.cumsum(lengths))), key[short], dropout)
    if short.all():
        return final, count
    parts = np.empty(len(size), object)
    parts[short] = np.split(final, np.cumsum(count)[:-1]) if len(count) else []
    for k in np.flatnonzero(~short):
        parts[k] = np.array(agenda(model, symbols[start[k] : start[k] + size[k]].tolist(), int(key[k]), dropout), np.int64)
    return np.concatenate(list(parts)), np.array([len(x) for x in parts])


class Known:
    """Units cut before, up to KEPT of them; the others are cut again when they come up."""

    def __init__(self):
        self.setting = None

    def resolve(self, setting: tuple, key: np.ndarray, cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, and where in them each unit of the ascending `key` has its own and how many."""
        if setting != self.setting:
            self.setting, self.keys = setting, np.zeros(0, np.uint64)
            self.at, self.count, self.symbols = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        offsets, counts = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        offsets[hit], counts[hit] = self.at[place[hit]], self.count[place[hit]]
        new = np.flatnonzero(~hit)
        found, count = cut(new) if len(new) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        offsets[new], counts[new] = len(self.symbols) + np.cumsum(count) - count, count
        symbols = np.concatenate((self.symbols, found.astype(np.int32)))
        if len(new) and len(self.keys) < KEPT:
            keys = np.concatenate((self.keys, key[new]))
            order = np.argsort(keys)
            self.at, self.count = (np.concatenate((a, b[new]))[order] for a, b in ((self.at, offsets), (self.count, counts)))
            self.keys, self.symbols = keys[order], symbols
        return symbols, offsets, counts


def _as_ids(model: Model, symbols: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no piece become their bytes."""
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    odd = np.flatnonzero(symbols >= model.size)
    if not len(odd):
        return symbols, bounds
    names = {v: ord(c) for c, v in model.symbol.items() if v >= model.size}
    raw = [chr(names.get(s, s - model.first_unknown)).encode() for s in symbols[odd].tolist()]
    width = np.ones(len(symbols), np.int64)
    width[odd] = [len(r) for r in raw]
    out = np.repeat(symbols, width)
    at = np.cumsum(width) - width
    for o, r in zip(at[odd].tolist(), raw):
        out[o : o + len(r)] = model.byte[list(r)]
    return out, np.concatenate((at, [len(out)]))[bounds]


def decode(model: Model, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that `ids` encode, and their offsets; the blank before each text goes."""
    width = np.diff(model.told_at)[ids]
    where = np.repeat(model.told_at[ids] - np.cumsum(width) + width, width) + np.arange(width.sum())
    data = model.told[where]
    bounds = np.concatenate(([0], np.cumsum(width)))[at]
    full = bounds[1:] > bounds[:-1]
    keep = np.ones(len(data), bool)
    keep[bounds[:-1][full]] = False
    return data[keep], bounds - np.concatenate(([0], np.cumsum(full)))


def encoded(docs: DataFrame, path: str, seed: int = 0, dropout: float = 0.1, variant: Column | None = None) -> DataFrame:
    """doc_id, ids and lossless for every row of documents (doc_id, text).

    `path` is a SentencePiece BPE model with byte pieces and without normalisation that every
    executor can read. Texts of one `variant` (default: one of 8, by a hash of doc_id) are cut alike.
    `lossless` tells that the ids decode to the text. A null or empty text has no ids. Repeated rows
    get equal results, further columns are ignored, an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    variant = F.pmod(F.xxhash64("doc_id"), F.lit(8)) if variant is None else variant

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in pieces(batches, "text", CHUNK):
            data, at = text_bytes(batch.column("text"))
            ids, of = encode(model, data, at, batch.column("variant").to_numpy(), seed, dropout)
            back, back_at = decode(model, ids, of)
            same = [
                b - a == d - c and bool((data[a:b] == back[c:d]).all())
                for a, b, c, d in zip(at[:-1], at[1:], back_at[:-1], back_at[1:])
            ]
            lists = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(same)], ["doc_id", "ids", "lossless"])

    rows = docs.select("doc_id", "text", variant.cast("long").alias("variant"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>, lossless boolean")


def id_digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_ids, the SHA-256 of the ids as 32-bit little-endian numbers, and lossless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids) else 0)
            digest = [hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(digest, pa.string()), batch.column("lossless")],
                ["doc_id", "n_ids", "ids_sha256", "lossless"],
            )

    return rows.mapInArrow(lean(run), "doc_id long, n_ids long, ids_sha256 string, lossless boolean")
