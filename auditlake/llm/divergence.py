"""Source divergence audit: how far the words of one source are from those of another, and where.

1. Identical texts of a language collapse to one row, with the number of their copies in each
   source beside it. A text is cut into terms once; its document frequency is added with the number
   of all copies, its counts with the number of copies of each source. What a task adds up is
   bounded and leaves it as sums.
2. A language keeps the terms that enough of its documents have; counts of kept terms are a sparse
   table (lang, source, term), from which each group's total follows.
3. A term that neither of two sources has contributes the same to their divergence whatever it is,
   so pairs of sources are evaluated over the terms that one of them has, and the rest is counted.
   Terms are dealt to chunks and sources to tiles; a task sees one chunk for two tiles, a group of
   bounded size, and returns a sum for each pair. Pairs are never rows by term.

All arithmetic is on integers: shares are scaled by SCALE, and quotients are rounded down.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.shared import small_batches, written

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP = 10
#: Sums held by a task before it passes them on, and bytes of text counted together.
HELD, TOGETHER = 500_000, 1 << 20
#: Sources in a tile and, on average, terms in a chunk.
TILE, CHUNK = 64, 512

#: Bytes of a term in lower case; every other byte is a blank. Bytes above 127 belong to terms.
_TERM = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_SUMS = "lang string, source string, term binary, n long, documents long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def counted(text: bytes) -> Counter:
    """Occurrences of a text's terms; a long text is cut into terms slice by slice."""
    spelled, out, low = text.translate(_TERM), Counter(), 0
    while low < len(spelled):
        high = spelled.find(b" ", low + TOGETHER)
        high = len(spelled) if high < 0 else high
        out.update(spelled[low:high].split())
        low = high
    return out


class _Sums:
    """Occurrences and documents by (lang, source) and term."""

    def __init__(self):
        self.counts: defaultdict[tuple, Counter] = defaultdict(Counter)
        self.documents: defaultdict[tuple, Counter] = defaultdict(Counter)
        self.once: defaultdict[tuple, list] = defaultdict(list)
        self.waiting = 0

    def add(self, lang: str, source: str, copies: int, terms: Counter) -> None:
        """So many copies of a text in a source."""
        counts, documents = self.counts[lang, source], self.documents[lang, source]
        for term, n in terms.items():
            counts[term] += copies * n
            documents[term] += copies

    def add_once(self, lang: str, source: str, text: bytes) -> None:
        """A text that the source has once; such texts are added many at a time."""
        self.once[lang, source].append(terms_of(text))
        self.waiting += len(text)
        if self.waiting >= TOGETHER:
            self.settle()

    def settle(self) -> None:
        for group, lists in self.once.items():
            self.counts[group].update(chain.from_iterable(lists))
            self.documents[group].update(chain.from_iterable(map(set, lists)))
        self.once.clear()
        self.waiting = 0

    def flushed(self, least: int) -> Iterator[pa.RecordBatch]:
        """All sums, once there are `least`."""
        if sum(map(len, self.counts.values())) < least:
            return
        for group, counts in self.counts.items():
            names = [pa.array([x] * len(counts), pa.string()) for x in group]
            numbers = [pa.array(x, pa.int64()) for x in (list(counts.values()), list(map(self.documents[group].__getitem__, counts)))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(counts), pa.binary()), *numbers], ["lang", "source", "term", "n", "documents"])
        self.counts.clear()
        self.documents.clear()


def _term_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their copies in a source, rows of one text in a row -> sums."""
    sums, key, terms = _Sums(), None, None
    for batch in batches:
        texts = batch.column("text")
        rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "digest", "source", "n", "sources")))
        for i, (lang, digest, source, n, sources) in enumerate(rows):
            if n == sources == 1 and len(text := texts[i].as_buffer()) < TOGETHER:
                sums.add_once(lang, source, text.to_pybytes())
                continue
            if digest != key:
                key, terms = digest, counted(texts[i].as_buffer().to_pybytes())
            sums.add(lang, source, n, terms)
        yield from sums.flushed(HELD)
    sums.settle()
    yield from sums.flushed(1)


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, digest, source, n, sources, text): each text of a lang with its copies in each source.

    `docs` holds lang, source and text without nulls. Copies are counted and texts made one before
    the shuffle, so a text with very many copies is a row for each task; it is shuffled once, and
    only numbers are joined to it.
    """
    docs = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = docs.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    sources = F.count("*").over(Window.partitionBy("lang", "digest")).alias("sources")
    texts = docs.groupBy("lang", "digest").agg(F.first(F.col("text").cast("binary")).alias("text"))
    return texts.join(copies.select("*", sources), ["lang", "digest"]).select("lang", "digest", "source", "n", "sources", "text")


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, of_lang, source, n, documents) for kept terms: occurrences in the lang and the group, documents in the group."""
    small_batches(docs.sparkSession)
    # One shuffle by term serves all sums, and rare terms end in it. Both readers ask for all of its
    # columns, so that it is one and the same.
    sums = collapsed(docs).mapInArrow(_term_sums, _SUMS).repartition("lang", "term")
    kept = sums.groupBy("lang", "term").agg(F.sum("documents").alias("found"), F.sum("n").alias("of_lang"), F.count("source").alias("rows"))
    kept = kept.where((F.col("found") >= least) & (F.col("rows") > 0)).select("lang", "term", "of_lang")
    counts = sums.join(kept.hint("shuffle_hash"), ["lang", "term"]).groupBy("lang", "term", "of_lang", "source")
    return counts.agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact; without terms 1 + 2 * SCALE."""
    above = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_facts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each (lang, source) of `docs`: total, terms and of_lang of the lang, share of a term
    without occurrences, tile, and how many tiles and chunks the lang has."""
    terms = counts.select("lang", "term", "of_lang").distinct()
    langs = terms.groupBy("lang").agg(F.sum("of_lang").alias("of_lang"), F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    groups = groups.join(sources, "lang").join(langs, "lang", "left").fillna(0, ["total", "of_lang", "terms"])
    return groups.select(
        "lang", "source", "total", "of_lang", "terms", "tiles", share(F.lit(0), F.col("total"), F.col("terms")).alias("none"),
        F.pmod(F.xxhash64("source"), "tiles").alias("tile"), F.greatest(F.ceil(F.col("terms") / CHUNK), F.lit(1)).alias("chunks"),
    )


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile_sums(left: np.ndarray, right: np.ndarray, left_none: np.ndarray, right_none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows: sum of gaps over the terms that one of them has, and their number.

    Rows are sources and columns terms; a cell without occurrences holds 0 and counts as `none`.
    """
    value, terms = (np.zeros((len(left), len(right)), np.int64) for _ in range(2))
    filled = np.where(right > 0, right, right_none[:, None])
    for k, row in enumerate(left):
        mine = np.flatnonzero(row)
        r, c = np.nonzero(np.where(row > 0, 0, right))
        # Sums of a chunk stay far below 2 ** 53, where floating point is exact.
        theirs = np.bincount(r, _gaps(left_none[k], right[r, c]), len(right)).astype(np.int64)
        value[k] = _gaps(row[mine], filled[:, mine]).sum(1) + theirs
        terms[k] = len(mine) + np.bincount(r, minlength=len(right))
    return value, terms


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """One chunk of terms of two tiles -> sums of the pairs between them."""
    lang, low, high = rows[["lang", "low", "high"]].iloc[0]
    column, names = pd.factorize(rows["term"])  # a row without a term only names its source
    sides = []
    for tile in (low, high):
        mine = (rows["tile"] == tile).to_numpy()
        row, sources = pd.factorize(rows["source"][mine])
        table, none = np.zeros((len(sources), len(names)), np.int64), np.zeros(len(sources), np.int64)
        none[row] = rows["none"][mine]
        seen = column[mine] >= 0
        table[row[seen], column[mine][seen]] = rows["p"][mine][seen]
        sides.append((np.asarray(sources, object), table, none))
    (a, left, left_none), (b, right, right_none) = sides
    value, terms = tile_sums(left, right, left_none, right_none)
    i, j = np.nonzero(a[:, None] < b if low == high else np.ones(value.shape, bool))
    return pd.DataFrame({
        "lang": lang, "a": a[i], "b": b[j], "value": value[i, j], "terms": terms[i, j], "none_a": left_none[i], "none_b": right_none[j],
    })


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a lang, both ways."""
    chunk = F.pmod(F.xxhash64("term"), "chunks")
    cells = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    cells = cells.select("lang", "source", "tile", "tiles", "none", chunk.alias("chunk"), "term", "p")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    every = groups.select("lang", "source", "tile", "tiles", "none", every, F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("p"))
    dealt = cells.unionByName(every).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("*", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")).drop("other", "tiles")
    sums = dealt.groupBy("lang", "low", "high", "chunk").applyInPandas(
        _tile, "lang string, a string, b string, value long, terms long, none_a long, none_b long"
    )
    sums = sums.groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("terms").alias("seen"), F.max("none_a").alias("none_a"), F.max("none_b").alias("none_b")
    )
    vocab = groups.groupBy("lang").agg(F.max("terms").alias("terms"))
    rest = (F.col("terms") - F.col("seen")) * gap(F.col("none_a"), F.col("none_b"))
    sums = sums.join(vocab, "lang").select("lang", "a", "b", (F.col("value") + rest).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")


def term_gaps(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for the terms a group has more often than its lang."""
    cells = counts.join(groups.drop("of_lang").join(groups.groupBy("lang").agg(F.max("of_lang").alias("all")), "lang"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("of_lang"), F.col("all"), F.col("terms"))
    cells = cells.select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return cells.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: divergences of the sources of each lang.

    Part `pair` has every other source of the lang with the divergence over all kept terms, part
    `term` the first `top` terms that the source has more often than its lang; ranks begin at 1, the
    largest value first, ties by the item's bytes. Terms are runs of letters (A-Z lower-cased) and
    non-ASCII characters; kept are those in `least` documents of the lang.

    Null text, lang and source count as ''. Rows are documents: repeated rows count as often as they
    occur. A lang with one source has no pair; without kept terms pairs have value 0. Further
    columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = written(term_counts(docs, least), "counts")
    groups = written(group_facts(docs, counts), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = pair_sums(counts, groups).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = term_gaps(counts, groups).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
