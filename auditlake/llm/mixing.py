"""Mixing overlapping sources to target sizes by minimum-cost flow, then choosing documents.

Documents are summed up by membership pattern, the set of sources they belong to. The pattern sums
are the supply of a flow network: pattern -> source -> quota. An arc out of a pattern is taken once
for each repetition, at a cost that rises with every repetition, so a second copy is used only when
first copies cannot fill a quota. The network has a node for each pattern and source, not for each
document. What the flow sends from a pattern is then realised by whole documents in a seeded order:
documents are summed up in hash buckets, a running sum over buckets finds the bucket where the flow
ends, and only inside that bucket documents are summed one by one. What is left, less than one
document, is filled with smaller documents in further passes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import written

#: Costs of one word of the first, second, ... copy: convex, so early copies go first.
COSTS = (0, 1)
#: Hash buckets of one pattern: this many, and one more for each PER_BUCKET documents.
BUCKETS, PER_BUCKET = 64, 2048
#: Passes after the first that fill what whole documents have left open.
PASSES = 3
#: An entry of `turns`: a pass takes a pattern's documents that fit before the bucket `edge`, and in it up to `stop`.
TURN = "struct<most:int,open:double,edge:long,stop:struct<order:long,doc_id:{},size:long>>"
SEPARATOR = "\x1f"
#: The flow is solved on the driver over patterns; more of them are refused, not cut off.
MAX_PATTERNS = 20_000


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of `total` by weight, none above `most` times its size; the excess is dealt again."""
    open_, out, left = {s for s in sizes if weights[s] > 0}, dict.fromkeys(sizes, 0.0), float(total)
    while open_:
        weight = sum(weights[s] for s in sorted(open_, key=_order))
        full = {s for s in open_ if left * weights[s] / weight >= most * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / weight for s in open_}
        for s in sorted(full, key=_order):
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def _order(source: str | None) -> tuple:
    """Code point order, null last."""
    return source is None, source or ""


def flow(supply: dict[tuple, int], quotas: dict, costs: Sequence[float] = COSTS) -> dict[tuple, float]:
    """{(pattern, source, copy): words}: the cheapest flow that fills the quotas as far as possible.

    Successive shortest paths: while some quota is open, words go along the cheapest path from a
    pattern that may still repeat to an open quota, which may take words of another source back
    and give them other words instead.
    """
    patterns, sources = sorted(supply, key=lambda p: tuple(map(_order, p))), sorted(quotas, key=_order)
    rest = {(p, k): float(supply[p]) for p in patterns for k in range(len(costs))}
    sent = dict.fromkeys(((p, s) for p in patterns for s in p if s in quotas), 0.0)
    open_ = {s: float(quotas[s]) for s in sources}
    members = {s: [p for p in patterns if s in p] for s in sources}
    while True:
        # Dijkstra backwards over patterns and sources; moving words between sources costs nothing.
        best, heap, ties = {}, [], count()
        for p in patterns:
            copy = next((k for k in range(len(costs)) if rest[p, k] > 1e-9), None)
            if copy is not None:
                heapq.heappush(heap, (costs[copy], 0, next(ties), ("pattern", p), None, copy))
        goal = None
        while heap:
            cost, steps, _, node, before, copy = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = (before, copy)
            kind, at = node
            if kind == "source":
                if open_[at] > 1e-6:
                    goal = node
                    break
                nexts = [("pattern", p) for p in members[at] if sent[p, at] > 1e-9]
            else:
                nexts = [("source", s) for s in at if s in quotas]
            for n in nexts:
                if n not in best:
                    heapq.heappush(heap, (cost, steps + 1, next(ties), n, node, copy))
        if goal is None:
            break
        path, node = [goal], goal
        while best[node][0] is not None:
            node = best[node][0]
            path.append(node)
        path, copy = path[::-1], best[goal][1]
        amount = min(open_[goal[1]], rest[path[0][1], copy])
        for a, b in zip(path, path[1:]):
            if a[0] == "source":
                amount = min(amount, sent[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "pattern":
                sent[a[1], b[1]] += amount
            else:
                sent[b[1], a[1]] -= amount
        rest[path[0][1], copy] -= amount
        open_[goal[1]] -= amount
    return _by_copy(patterns, supply, sent, len(costs))


def _by_copy(patterns: list, supply: dict, sent: dict, copies: int) -> dict[tuple, float]:
    """Deals a pattern's words to its sources, first copies first."""
    out = {}
    for p in patterns:
        copy, room = 0, float(supply[p])
        for s in sorted((s for s in p if (p, s) in sent), key=_order):
            left = sent[p, s]
            while left > 1e-9 and copy < copies:
                part = min(left, room)
                out[p, s, copy] = out.get((p, s, copy), 0.0) + part
                left, room = left - part, room - part
                if room <= 1e-9:
                    copy, room = copy + 1, float(supply[p])
    return out


def copies_plan(docs: DataFrame, flows: dict[tuple, float], seed: int, copies: int = len(COSTS)) -> DataFrame:
    """What decides how often the mix takes each of `docs` (doc_id, pattern, size, digest), a row for each pattern.

    Copies that the flow takes of all of a pattern's documents are added as they are (`whole`); the
    part of a further copy is filled up to the flow by whole documents in a seeded order, and what large
    documents leave open by second copies of smaller ones. Every pass that fills is an entry of `turns`.
    """
    spark = docs.sparkSession
    taken: dict[tuple, float] = {}
    for (p, _, _), words in flows.items():
        taken[p] = taken.get(p, 0.0) + words
    summed = docs.groupBy("pattern").agg(F.sum("size").alias("supply"), F.count("*").alias("n"))
    wanted = spark.createDataFrame([(key(p), w) for p, w in taken.items()], "pattern string, wanted double")
    plan = written(summed.join(F.broadcast(wanted), "pattern", "left").select(
        "pattern", "supply",
        (F.lit(BUCKETS) + F.col("n") / F.lit(PER_BUCKET)).cast("long").alias("buckets"),
        F.least(F.coalesce("wanted", F.lit(0.0)), F.lit(float(copies)) * F.col("supply")).alias("wanted"),
        F.lit(seed).alias("seed"),
    ).withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("wanted") / F.col("supply") + 1e-9)).otherwise(0))
     .withColumn("open", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole") * F.col("supply")))
     .withColumn("turns", F.array().cast(f"array<{_turn(docs)}>")), "plan")
    for turn in range(1 + 2 * PASSES):
        plan = _fill(docs, plan, copies if turn > PASSES else 1)
    return plan


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """`docs` (doc_id, pattern, size, digest and others) with `copies`, by copies_plan(); no row is moved."""
    rows = _placed(docs, plan)
    return rows.withColumn("copies", (F.col("whole") + F.col("extra")).cast("long")).select(*docs.columns, "copies")


def _placed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """`docs` with their place in the seeded order and the further copies (`extra`) of the turns so far."""
    rows = docs.join(F.broadcast(plan), "pattern").withColumn("order", F.xxhash64("seed", "doc_id", "digest"))
    rows = rows.withColumn("bucket", F.pmod("order", "buckets"))

    def more(extra: Column, turn: Column) -> Column:
        before = F.col("bucket") < turn["edge"]
        part = (F.col("bucket") == turn["edge"]) & (_place() <= turn["stop"])
        chosen = turn["edge"].isNull() | before | F.coalesce(part, F.lit(False))
        return extra + (_fits(extra, turn["most"], turn["open"]) & chosen).cast("int")

    return rows.withColumn("extra", F.aggregate("turns", F.lit(0), more))


def _turn(docs: DataFrame) -> str:
    return TURN.format(docs.schema["doc_id"].dataType.simpleString())


def _place() -> Column:
    return F.struct("order", "doc_id", "size")


def _fits(extra: Column, most: Column, open_: Column) -> Column:
    """With `most` 1 documents that have no further copy yet, otherwise all that have fewer than `most`; none larger than what is open."""
    room = F.when(most == 1, extra == 0).otherwise(F.col("whole") + extra < most)
    return room & (F.col("size") > 0) & (F.col("size") <= open_)


def _fill(docs: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """One pass: documents no larger than what is open, in order, while they fit."""
    rows = _placed(docs, plan).where(_fits(F.col("extra"), F.lit(most), F.col("open")))
    buckets = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum"), F.first("open").alias("open"))
    before = F.sum("sum").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("before", F.coalesce(before, F.lit(0)))
    # Only the one bucket of a pattern in which the open words run out is ordered.
    last = F.col("before").alias("edge_before"), F.col("bucket").alias("edge"), (F.col("before") + F.col("sum") > F.col("open")).alias("over")
    ends = buckets.where("before <= open").groupBy("pattern").agg(F.max(F.struct(*last, "sum")).alias("last")).select("pattern", "last.*")
    ends = written(ends.select(
        "pattern", F.when(F.col("over"), F.col("edge")).alias("edge"), "edge_before",
        (F.col("edge_before") + F.when(F.col("over"), 0).otherwise(F.col("sum"))).alias("used"),
    ), "ends")
    at_edge = rows.join(F.broadcast(ends.drop("used")), "pattern").where("bucket = edge")
    within = F.sum("size").over(Window.partitionBy("pattern").orderBy("order", "doc_id", "size"))
    inside = at_edge.withColumn("until", F.col("edge_before") + within).where("until <= open")
    stop = inside.groupBy("pattern").agg(F.max(_place()).alias("stop"), F.max("until").alias("until"))
    told = plan.join(F.broadcast(ends.drop("edge_before")), "pattern", "left").join(F.broadcast(stop), "pattern", "left")
    turn = F.struct(F.lit(most).alias("most"), "open", "edge", "stop").cast(_turn(docs))
    used = F.coalesce("until", "used", F.lit(0))
    told = told.withColumn("turns", F.concat("turns", F.array(turn))).withColumn("open", F.col("open") - used)
    return written(told.select(plan.columns), "plan")


def key(pattern: tuple) -> str:
    """A pattern as text: its sources in order, null as an escape no source can be."""
    return SEPARATOR.join(sorted({_escape(s) for s in pattern}))


def _escape(source: str | None) -> str:
    return "\\N" if source is None else source.replace("\\", "\\\\").replace(SEPARATOR, "\\s")


def _key(sources: Column) -> Column:
    plain = F.transform(sources, lambda s: F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit(SEPARATOR), F.lit("\\s")))
    part = F.transform(plain, lambda s: F.coalesce(s, F.lit("\\N")))
    return F.array_join(F.array_sort(F.array_distinct(part)), SEPARATOR)


def _sources(pattern: str) -> tuple:
    def plain(part: str) -> str | None:
        return None if part == "\\N" else re.sub(r"\\(.)", lambda m: SEPARATOR if m[1] == "s" else m[1], part)

    return tuple(sorted(map(plain, pattern.split(SEPARATOR)), key=_order))


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, seed: int = 17,
        sources: Column | None = None) -> DataFrame:
    """(doc_id, pattern, size, target_source, copies) for every row of documents (doc_id, text, source).

    A document's size is its number of words (null text: 0). `sources` is an array of the sources
    a document belongs to (default: its one source; a null source, like an empty list, is a source of
    its own). There may be MAX_PATTERNS different lists; that bounds what is broadcast. Sources in
    code point order, null last, get the weights in turn and that share of `share` times all sizes,
    none more than `most` times its own size, with the excess dealt again by weight. `copies` is how
    often the mix takes the document: whole documents, at most `most` times. The taken words of a
    source differ from its target by less than its smallest document not taken, unless sources
    compete for the same documents. Rows that repeat a doc_id are documents of their own; equal
    rows are taken equally often. An empty
    table gives an empty table; further columns are ignored. Equal seeds give equal results.
    """
    rows = sized_rows(docs.select("doc_id", "text", "source") if sources is None else docs, sources).select("doc_id", "size", "pattern", "digest")
    rows = written(rows, "sizes")
    plan, facts = _planned(rows, weights, share, most, seed)
    told = docs.sparkSession.createDataFrame(facts, "pattern string, target double, source_size long")
    return with_copies(rows, plan).select("pattern", "doc_id", "size", "copies").join(F.broadcast(told), "pattern")


def mixed_rows(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of documents (doc_id, text, source, ...) with `copies` as mix() tells them. No text is shuffled:
    what decides is broadcast, a row for each pattern. Columns pattern, size and digest are added.
    """
    rows = sized_rows(docs)
    plan, _ = _planned(written(rows.select("doc_id", "size", "pattern", "digest"), "sizes"), weights, share, most, seed)
    return with_copies(rows, plan)


def sized_rows(docs: DataFrame, sources: Column | None = None) -> DataFrame:
    """`docs` with `size`, membership `pattern` and `digest` of the text."""
    sources = F.array("source") if sources is None else sources
    sources = F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))
    return docs.withColumns({"size": n_words(F.col("text")), "pattern": _key(sources), "digest": F.xxhash64("text")})


def _planned(sized: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> tuple[DataFrame, list[tuple]]:
    """copies_plan() of documents (doc_id, size, pattern, digest), and the target and size of each pattern's sources."""
    summed = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(summed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    supply = {_sources(r.pattern): int(r["size"]) for r in summed}
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=_order)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    targets = capped_targets(sizes, weight, share * sum(supply.values()), most)
    flows = flow(supply, targets, tuple(range(int(most))))
    return copies_plan(sized, flows, seed, int(most)), [(key(p), float(sum(targets[s] for s in p)), int(sum(sizes[s] for s in p))) for p in supply]
