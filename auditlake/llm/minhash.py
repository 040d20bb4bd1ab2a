"""Near-duplicate groups by MinHash bands with sequential Bayesian verification.

1. Every text gets a MinHash signature and the digest of its shingle set. Texts with equal sets
   form one class, so thousands of copies are one row from here on.
2. Classes that agree in a band of the signature meet in a bucket. Two rounds of minima over the
   buckets give classes that share many buckets one root; the classes of a root are dealt to blocks
   of bounded size and compared within them. Linked classes become one component, and a few members
   of each go on in its place until that joins few more.
3. Classes that share a bucket but are still in different components become pairs only if their
   rarest shingles meet: sets that reach the threshold must, however common their other shingles
   are, and bounds on their sizes keep these prefixes short. While that joins many components each
   class is paired with a few under its keys; in the end all are compared, pairs of blocks at a
   time. Classes of one component are not, so the work follows the components that stay apart.
4. Signatures of two classes are compared step by step. After each step the posterior probability
   that the similarity reaches the threshold, given the agreements so far and a uniform prior, is
   bounded; a pair whose probability is below `MISS` is dropped. Pairs that survive are decided on
   their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.components import components
from auditlake.llm.shared import lean, release, screened, small_batches, written
from auditlake.llm.texts import LOWER, Words, alike, mixed, pieces, text_bytes

WORDS = 5
#: Rows in a band, and the chance that a pair at the threshold agrees in no band.
ROWS, UNMET = 5, 1e-5
#: Chosen probability of dropping a pair that reaches the threshold, after each block.
MISS = 1e-6
BLOCK = 10
#: Bytes of shingle sets in a block of classes.
BLOCK_BYTES = 1 << 20
#: Members of a component that are compared on its behalf before whole blocks are.
REPRESENTATIVES = 4
#: Classes that all others under a key are compared with before all pairs are.
SAMPLED = 3
#: Sizes of sets in a band differ by this factor at most.
RATIO = 1.03
#: Columns of the tables that count intersections, and pairs of signatures compared at once.
COLUMNS, PAIRS = 8192, 1 << 17

_PLACE = np.random.default_rng(7).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_BYTES = "8 * n_shingles + 500"
SKETCH = "doc_id long, hash long, n_shingles long, digest string, keys binary"


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and the offsets of the texts."""
    words = Words(data, at)
    each, count = words.hashes(LOWER), words.count
    if not len(each):
        return each, np.zeros(words.n_texts + 1, np.int64)
    short = (count > 0) & (count < WORDS)
    full = len(each) - WORDS + 1
    hashed = np.zeros(max(full, 0), np.uint64)
    for k in range(WORDS if full > 0 else 0):
        hashed += each[k : k + full] * _PLACE[k]
    inside = words.text[:full] == words.text[WORDS - 1 :] if full > 0 else np.zeros(0, bool)
    values, owner = mixed(hashed[inside]), words.text[:full][inside] if full > 0 else np.zeros(0, np.int64)
    if short.any():
        mine = np.flatnonzero(short)
        place = np.arange(len(each)) - words.first[words.text]
        kept = short[words.text]
        part = each[kept] * _PLACE[place[kept]]
        sums = np.add.reduceat(part, np.searchsorted(words.text[kept], mine)) + count[mine].astype(np.uint64)
        values, owner = np.concatenate((values, mixed(sums))), np.concatenate((owner, mine))
    # Sorted by text and value: values fall into place by a sort inside each text's slice.
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(words.n_texts + 1))


def signature_size(threshold: Fraction) -> int:
    """Values of a signature whose bands a pair at the threshold misses with a chance of UNMET."""
    return ROWS * math.ceil(math.log(UNMET) / math.log(1 - float(threshold) ** ROWS)) if threshold < 1 else ROWS


def signatures(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The MinHash signature of each non-empty set, one row of `size` 32-bit values a set."""
    full = np.flatnonzero(at[1:] > at[:-1])
    out = np.empty((len(full), size), np.uint32)
    flip, multiply = np.random.default_rng(11).integers(0, 1 << 63, (size, 2), dtype=np.uint64).T
    multiply = multiply * np.uint64(2) + np.uint64(1)
    if len(full):
        starts = at[:-1][full]
        for k in range(size):
            least = np.minimum.reduceat((values ^ flip[k]) * multiply[k], starts)
            out[:, k] = (least >> np.uint64(32)).astype(np.uint32)
    return out


def _digests(values: np.ndarray, of: np.ndarray) -> list[str | None]:
    return [
        hashlib.blake2b(values[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None
        for a, b in zip(of[:-1].tolist(), of[1:].tolist())
    ]


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A hash of every band of every signature, one row a signature."""
    bands = signed.shape[1] // ROWS
    signed = signed.reshape(len(signed), bands, ROWS).astype(np.uint64)
    key = np.repeat(np.arange(bands, dtype=np.uint64)[None], len(signed), 0)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, k])
    return key


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values, of = shingles(*text_bytes(batch.column("text")))
            rows = iter(band_keys(signatures(values, of, size)))
            keys = [next(rows).tobytes() if b > a else None for a, b in zip(of[:-1], of[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("hash"), pa.array(np.diff(of)), pa.array(_digests(values, of), pa.string()),
                    pa.array(keys, pa.binary()),
                ],
                ["doc_id", "hash", "n_shingles", "digest", "keys"],
            )

    return run


def sketches(docs: DataFrame, threshold: Fraction) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the shingle set and keys of the signature's bands for every text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(lean(_sketches(signature_size(threshold))), SKETCH)


# ---- posterior bounds

def least_agreements(threshold: Fraction, miss: float = MISS) -> dict[int, int]:
    """For 10, 20, ... compared values: agreements below which P(similarity >= threshold) < miss.

    With a uniform prior the posterior after m agreements in n is Beta(m + 1, n - m + 1), whose
    tail above t is the chance of at most m successes in n + 1 trials of probability t.
    """
    t, out = float(threshold), {}
    for n in range(BLOCK, signature_size(threshold) + 1, BLOCK):
        term, tail, m = (1 - t) ** (n + 1), 0.0, 0
        while m <= n:
            tail += term
            if tail >= miss:
                break
            term *= (n + 1 - m) / (m + 1) * t / (1 - t)
            m += 1
        out[n] = m
    return out


def survivors(left: np.ndarray, right: np.ndarray, bounds: dict[int, int]) -> np.ndarray:
    """Which rows of two signature matrices stay after the sequential test by least_agreements()."""
    alive, agreed, low = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in bounds.items():
        agreed = agreed + (left[alive, low:n] == right[alive, low:n]).sum(1)
        stay = agreed >= least
        alive, agreed, low = alive[stay], agreed[stay], n
    return alive


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (a, row_a), (b, row_b) = flat(left), flat(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    for low in range(0, len(both), COLUMNS):
        part = both[low : low + COLUMNS]
        tables = []
        for values, rows, n in ((a, row_a, len(left)), (b, row_b, len(right))):
            at = np.searchsorted(part, values)
            hit = part[np.minimum(at, len(part) - 1)] == values
            table = np.zeros((n, len(part)), np.float32)
            table[rows[hit], at[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def linked(left: tuple, right: tuple, threshold: Fraction, bounds: dict[int, int]) -> np.ndarray:
    """Which pairs of two blocks (signatures, sets) reach the threshold: likely ones, then exactly."""
    (sign_a, sets_a), (sign_b, sets_b) = left, right
    n, least = next(iter(bounds.items()), (0, 0))
    i, j = np.nonzero((sign_a[:, None, :n] == sign_b[None, :, :n]).sum(2) >= least)
    out = np.zeros((len(sign_a), len(sign_b)), bool)
    for low in range(0, len(i), PAIRS):
        a, b = i[low : low + PAIRS], j[low : low + PAIRS]
        alive = survivors(sign_a[a], sign_b[b], bounds)
        out[a[alive], b[alive]] = True
    rows, columns = np.flatnonzero(out.any(1)), np.flatnonzero(out.any(0))
    if len(rows):
        both = _shared_counts([sets_a[k] for k in rows], [sets_b[k] for k in columns]).astype(np.int64)
        size_a, size_b = (np.array([len(s) for s in x]) for x in ([sets_a[k] for k in rows], [sets_b[k] for k in columns]))
        union = size_a[:, None] + size_b - both
        out[np.ix_(rows, columns)] &= both * threshold.denominator >= threshold.numerator * union
    return out


def smallest_reached(ids_a: np.ndarray, ids_b: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every id on either side the smallest id its links lead to."""
    far = np.iinfo(np.int64).max
    near_a, near_b = ids_a.copy(), ids_b.copy()
    while True:
        new_b = np.minimum(near_b, np.where(link, near_a[:, None], far).min(0))
        new_a = np.minimum(near_a, np.where(link, new_b[None], far).min(1))
        if (new_a == near_a).all() and (new_b == near_b).all():
            return near_a, near_b
        near_a, near_b = new_a, new_b


def _block(members: list[dict]) -> tuple[np.ndarray, tuple]:
    sign = np.frombuffer(b"".join(m["signature"] for m in members), np.uint32).reshape(len(members), -1)
    return np.array([m["class_id"] for m in members]), (sign, [np.frombuffer(m["shingles"], np.uint64) for m in members])


def _links(threshold: Fraction):
    """Blocks `left` and, for a pair of different ones, `right` -> a link (a, b) for each class, to the smallest that its links lead to."""

    bounds = least_agreements(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids_a, left = _block(batch.column("left")[k].as_py())
                other = batch.column("right")[k].as_py() if "right" in batch.schema.names else None
                ids_b, right = (ids_a, left) if other is None else _block(other)
                near_a, near_b = smallest_reached(ids_a, ids_b, linked(left, right, threshold, bounds))
                ids, near = np.concatenate((ids_a, ids_b)), np.concatenate((near_a, near_b))
                moved = near < ids
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(near[moved])], ["a", "b"])

    return run


def _members(size: int):
    """Texts -> signature and full shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values, of = shingles(*text_bytes(batch.column("text")))
            full = np.flatnonzero(of[1:] > of[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class_id").take(pa.array(full)),
                    pa.array([x.tobytes() for x in signatures(values, of, size)], pa.binary()),
                    pa.array([values[of[k] : of[k + 1]].tobytes() for k in full], pa.binary()),
                ],
                ["class_id", "signature", "shingles"],
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            of = np.repeat(batch.column("class_id").to_numpy(), len(keys) // batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(of)], ["key", "class_id"])


def _rooted(members: DataFrame) -> DataFrame:
    """(comp, root): the smallest component two steps away over shared buckets (key, comp).

    Two rounds suffice where components share many buckets; where only a chain of buckets holds
    them together, they stay apart until links have contracted them or pairs of blocks bridge them.
    """
    rooted = members.withColumn("root", F.col("comp"))
    for _ in range(2):
        least = rooted.groupBy("key").agg(F.min("root").alias("root"))
        root = members.join(least, "key").groupBy("comp").agg(F.min("root").alias("root"))
        root = written(root, "roots")
        rooted = members.join(root, "comp")
    return root


def _dealt(rows: DataFrame, turn: int) -> DataFrame:
    """(class_id, block) of rows (class_id, n_shingles, root): blocks of about BLOCK_BYTES of shingle sets."""
    size = rows.groupBy("root").agg(F.sum(F.expr(_BYTES)).alias("bytes"))
    parts = size.select("root", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts"))
    part = F.pmod(F.xxhash64("class_id", F.lit(turn)), "parts")
    return rows.join(parts, "root").select("class_id", F.xxhash64("root", part).alias("block"))


def _blocks(sets: DataFrame, dealt: DataFrame) -> DataFrame:
    member = F.struct("class_id", "signature", "shingles")
    return sets.join(dealt, "class_id").groupBy("block").agg(F.collect_list(member).alias("members"))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (class_id, comp) after links (a, b) between classes."""
    of_a, of_b = (label.select(F.col("class_id").alias(k), F.col("comp").alias(f"comp_{k}")) for k in "ab")
    over = links.join(of_a, "a").join(of_b, "b").where("comp_a <> comp_b")
    moved = components(over.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).withColumnRenamed("node", "comp")
    return written(label.join(moved, "comp", "left").select("class_id", F.coalesce("component", "comp").alias("comp")), "labels")


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members (key, class_id, ...), with their `comp` now, of the buckets or keys that still hold several components."""
    at = members.drop("comp").join(label, "class_id")
    several = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return written(at.join(several, "key"), "members")


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
        if sets:
            n = np.array([len(x) for x in sets])
            of = pa.array(np.repeat(batch.column("class_id").to_numpy(), n))
            yield pa.RecordBatch.from_arrays([of, pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.concatenate(sets))], ["class_id", "n", "value"])


def prefix_keys(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(key, class_id, n) of sets (class_id, shingles): sets that are alike share a key.

    Sets of a and b shingles that reach the threshold t have at least t / (1 + t) * (a + b) in
    common. With the rarest shingles first, the first a - common + 1 of the one then meet the first
    b - common + 1 of the other. Sizes fall into bands of RATIO, and a set has a key for each band
    that partners may be in, with the prefix that the smallest partner there needs; so sets that
    only share what very many share have no key in common.
    """
    up, down = threshold.numerator, threshold.denominator
    values = sets.select("class_id", "shingles").mapInArrow(lean(_values), "class_id long, n int, value long")
    often = values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    # A shingle of one set only is no key; such ones come first in the set and need not be shuffled with it.
    of = Window.partitionBy("class_id", "n")
    place = F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("often", "value"))
    ranked = values.join(often, "value").withColumn("place", place)

    def band(size: Column) -> Column:
        return F.floor(F.log(size) / F.lit(math.log(RATIO)))

    def prefix(partner: Column) -> Column:
        return F.col("n") - F.ceil((F.col("n") + partner) * up / F.lit(up + down).cast("decimal(10,0)")) + 1

    fewest, most = F.ceil(F.col("n") * up / F.lit(down).cast("decimal(10,0)")), F.floor(F.col("n") * down / F.lit(up).cast("decimal(10,0)"))
    first = ranked.where(F.col("place") <= prefix(fewest))
    each = first.withColumn("other", F.explode(F.sequence(band(fewest), band(most)))).withColumn("own", band(F.col("n")))
    smallest = F.greatest(fewest.cast("long"), F.floor(F.pow(F.lit(RATIO), F.col("other")) * (1 - 1e-9)))
    each = each.where(F.col("place") <= prefix(smallest))
    key = F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other"))
    return each.select(key.alias("key"), "class_id", F.col("n").cast("long").alias("n"))


def sampled_pairs(at: DataFrame, threshold: Fraction, turn: int) -> DataFrame:
    """(a, b), a < b: classes of `at` (key, class_id, comp, n) in different components, one of them among SAMPLED under a key.

    Others are sampled in each turn.
    """
    member = F.struct("class_id", "comp", "n")
    some = [F.min_by(member, F.xxhash64("class_id", F.lit(SAMPLED * turn + k))) for k in range(SAMPLED)]
    chosen = at.groupBy("key").agg(F.array_distinct(F.array(*some)).alias("some"))
    some_at = chosen.select("key", F.explode("some").alias("one")).select("key", "one.*")
    other = at.select("key", F.col("class_id").alias("other_id"), F.col("comp").alias("other"), F.col("n").alias("m"))
    up, down = threshold.numerator, threshold.denominator
    alike = (F.least("n", "m") * down >= F.greatest("n", "m") * up) & (F.col("comp") != F.col("other"))
    both = [f("class_id", "other_id").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
    return some_at.join(other, "key").where(alike).select(*both).distinct()


def block_pairs(at: DataFrame) -> DataFrame:
    """(x, y), x <= y: blocks of `at` (key, block, only) with a key in common.

    `only` is the component of a block that holds one component, otherwise -1; blocks of one
    component are not paired with each other or with themselves. Keys with the same blocks count
    once.
    """
    blocks = at.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("block", "only"))).alias("blocks"))
    blocks = blocks.select("blocks").distinct()
    pairs = blocks.select(F.explode("blocks").alias("x"), "blocks").select("x", F.explode("blocks").alias("y"))
    apart = (F.col("x.only") != F.col("y.only")) | (F.col("x.only") == -1)
    return pairs.where((F.col("x.block") <= F.col("y.block")) & apart).select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()


def _likely(threshold: Fraction):
    """Pairs with their signatures -> pairs that the sequential test leaves."""
    size, bounds = signature_size(threshold), least_agreements(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, size)
                for c in ("left", "right")
            )
            yield batch.select(["a", "b"]).take(pa.array(survivors(left, right, bounds)))

    return run


def _certain(threshold: Fraction):
    """Pairs with their full sets -> pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                left, right = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = alike(left, right)
                linked.append(both * threshold.denominator >= threshold.numerator * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    for name, side in (("a", "left"), ("b", "right")):
        pairs = pairs.join(sets.select(F.col("class_id").alias(name), F.col(column).alias(side)), name)
    return pairs.select("a", "b", "left", "right")


def linked_pairs(sets: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """The links among `pairs` (a, b)."""
    likely = written(_beside(written(pairs, "pairs"), sets, "signature").mapInArrow(lean(_likely(threshold)), "a long, b long"), "likely")
    return written(_beside(likely, sets, "shingles").mapInArrow(lean(_certain(threshold)), "a long, b long"), "links")


def class_components(classes: DataFrame, docs: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, component) of the classes that share a bucket with others."""
    small_batches(docs.sparkSession)
    values = signature_size(threshold)
    keys = classes.select("class_id", "keys").mapInArrow(lean(_keys), "key long, class_id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = written(keys.join(shared, "key").select("key", "class_id", F.col("class_id").alias("comp")), "members")
    label = written(members.select("class_id", "comp").distinct(), "labels")
    size = classes.select("class_id", "n_shingles")
    # Only texts of classes in shared buckets are shuffled, and few others; one text of each class.
    wanted = written(classes.select("class_id", "hash").join(label.select("class_id"), "class_id"), "wanted")
    full = screened(docs.select(F.col("doc_id").alias("class_id"), "text", F.xxhash64("text").alias("hash")), "class_id", wanted.select("class_id"), "likely")
    full = full.where("likely").join(wanted, ["class_id", "hash"]).dropDuplicates(["class_id", "hash"])
    sets = written(full.mapInArrow(lean(_members(values)), "class_id long, signature binary, shingles binary"), "sets")

    # A few members of each component, at first every class, are compared within one block.
    before = None
    for turn in count():
        n = members.agg(F.countDistinct("comp")).first()[0]
        if not n or before is not None and 2 * n > before:
            break
        before = n
        some = [F.min_by("class_id", F.xxhash64("class_id", F.lit(REPRESENTATIVES * turn + k))) for k in range(REPRESENTATIVES)]
        chosen = members.groupBy("comp").agg(F.array_distinct(F.array(*some)).alias("ids"))
        chosen = chosen.join(_rooted(members), "comp").select("root", F.explode("ids").alias("class_id"))
        blocks = _blocks(sets, _dealt(chosen.join(size, "class_id"), turn)).where(F.size("members") > 1)
        links = blocks.select(F.col("members").alias("left")).mapInArrow(lean(_links(threshold)), "a long, b long")
        label = _merged(label, written(links, "links"))
        members = _open(members, label)

    # What is still apart: classes of different components whose rarest shingles meet. While that
    # joins many components, a class meets a few others.
    if n:
        keys = at = written(prefix_keys(sets.join(members.select("class_id").distinct(), "class_id"), threshold), "keys")
        before = None
        for turn in count():
            at = _open(at, label)
            if keys is not None:
                keys = release(keys)
            n = at.agg(F.countDistinct("comp")).first()[0]
            if not n or before is not None and 10 * n > 9 * before:
                break
            before = n
            label = _merged(label, linked_pairs(sets, sampled_pairs(at, threshold, turn), threshold))

    # In the end it meets all of them, pairs of blocks at a time. Large components have blocks of
    # their own, which are not paired with each other.
    if n:
        rows = at.select("class_id", "comp", F.col("n").alias("n_shingles")).distinct()
        large = rows.groupBy("comp").agg((F.sum(F.expr(_BYTES)) > BLOCK_BYTES // 2).alias("large")).join(_rooted(at), "comp")
        group = F.when(F.col("large"), F.xxhash64("root", "comp")).otherwise(F.xxhash64("root"))
        rows = rows.join(large.select("comp", "large", group.alias("root")), "comp")
        dealt = written(_dealt(rows.select("class_id", "n_shingles", "root"), 0), "dealt")
        only = rows.select("class_id", F.when(F.col("large"), F.col("comp")).otherwise(F.lit(-1)).alias("only"))
        of = at.select("key", "class_id").join(dealt, "class_id").join(only, "class_id").select("key", "block", "only")
        blocks = written(_blocks(sets, dealt), "blocks")
        both = written(block_pairs(of), "pairs")
        both = both.join(blocks.select(F.col("block").alias("x"), F.col("members").alias("left")), "x")
        both = both.join(blocks.select(F.col("block").alias("y"), F.col("members").alias("right")), "y")
        links = both.select("left", "right").mapInArrow(lean(_links(threshold)), "a long, b long")
        label = _merged(label, written(links, "links"))
        release(blocks)
    release(sets)
    return label.select(F.col("class_id").alias("node"), F.col("comp").alias("component"))


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents (doc_id, text).

    Two texts are linked if the Jaccard similarity of their sets of distinct 5-word shingles
    (A-Z lower-cased; a shorter text is one shingle of all its words) is at least `threshold`;
    component_id is the smallest doc_id that links lead to, and the row with that id is kept.
    A null text or one without words has an empty set, is linked with nothing and is its own
    component. Rows that repeat a doc_id are judged by their own texts; a class of equal sets goes
    by its smallest doc_id. A row without a doc_id joins the group of equal sets, if any, and is kept
    otherwise. Further columns of `docs` are ignored; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    sketch = written(sketches(docs, threshold), "sketches")
    classes = written(
        sketch.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "hash")).alias("one"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles"))
        .select("digest", F.col("one.doc_id").alias("class_id"), F.col("one.hash").alias("hash"), "keys", "n_shingles"),
        "classes",
    )
    component = class_components(classes, docs, threshold).withColumnRenamed("node", "class_id")
    class_of = classes.select("digest", "class_id").join(component, "class_id", "left")
    class_of = class_of.select("digest", F.coalesce("component", "class_id").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(class_of, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    out = written(out.select("doc_id", "n_shingles", "component_id", kept), "near")
    release(sketch)
    release(classes)
    return out
