"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are first summed by membership pattern (the set
of sources they belong to); a flow then routes words from patterns to source quotas. A
pattern's first pass over its words is free and each further pass costs more, so repeats
are used only where quotas ask for them. The flow gives each pattern a number of words, that is whole
passes plus a part of one; a seeded order of its documents picks those that make up the part.

Targets: a budget is shared among sources by weight; no source gets more than LIMIT times its
words, and what it cannot take is shared again by weight until none is above.

The driver holds patterns and sources (thousands), never documents. A part of a pass is cut at a hash:
sums over 2**16 ranges of the hash find the range in which it ends, and only that range's
documents, a 65536th of them, are ordered.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a
document with an empty set of sources belongs to none and is not taken; repeated rows are
separate documents; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import ROW, WORD, bounded, numbered, store

SEED = 7
SHARE = Fraction(3, 2)
LIMIT = 2
CYCLE = (3, 1, 2)
RANGE_BITS = 16
#: Columns unlike any of the tables'.
TURNS, TURN = "__turns", "__turn"
#: Times that what is missing of a part is filled with smaller documents.
FILLS = 4


def targets(sizes: list[int], weights: list[Fraction | int], budget: Fraction, limit: int = LIMIT) -> list[Fraction]:
    """Shares of a budget by weight, each at most ``limit`` times its size, exactly."""
    out, open_, left = [Fraction(0)] * len(sizes), list(range(len(sizes))), Fraction(budget)
    while open_:
        total = sum((Fraction(weights[k]) for k in open_), Fraction(0))
        if total == 0:
            break
        full = [k for k in open_ if left * weights[k] / total > limit * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = Fraction(limit * sizes[k])
        left -= sum((out[k] for k in full), Fraction(0))
        open_ = [k for k in open_ if k not in full]
    return out


def flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], passes: int = LIMIT) -> list[dict[int, int]]:
    """Words of each pattern for each of its sources: the cheapest flow that fills quotas as far as it can.

    Successive shortest paths on a graph of two layers; pass k over a pattern costs k a word
    (0 for the first), so that costs are convex and repeats are spread evenly.
    """
    n, start, end = len(patterns), 0, 1
    graph: list[list[list[int]]] = [[] for _ in range(2 + n + len(quotas))]

    def link(u: int, v: int, room: int, cost: int) -> None:
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for k, (members, size) in enumerate(patterns):
        for turn in range(passes):
            link(start, 2 + k, size, turn)
        for s in members:
            link(2 + k, 2 + n + s, passes * size, 0)
    for s, quota in enumerate(quotas):
        link(2 + n + s, end, quota, 0)
    height = [0] * len(graph)
    while True:
        far, back, queue = {start: 0}, {}, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for k, (v, room, cost, _) in enumerate(graph[u]):
                if room > 0 and (x := d + cost + height[u] - height[v]) < far.get(v, x + 1):
                    far[v], back[v] = x, (u, k)
                    heapq.heappush(queue, (x, v))
        if end not in far:
            break
        height = [h + far.get(v, max(far.values())) for v, h in enumerate(height)]
        path, v = [], end
        while v != start:
            u, k = back[v]
            path.append((u, k))
            v = u
        amount = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= amount
            graph[graph[u][k][0]][graph[u][k][3]][1] += amount
    return [{e[0] - 2 - n: passes * size - e[1] for e in graph[2 + k] if e[0] >= 2 + n} for k, (_, size) in enumerate(patterns)]


def words(text: str = "text") -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, members: Column | None = None) -> DataFrame:
    """(doc_id, size, members, place), and the row's number where it has one: place is a seeded hash that orders the documents of a pattern."""
    members = F.array(F.col("source").cast("string")) if members is None else F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    row = [ROW] if ROW in docs.columns else []
    return docs.select("doc_id", *row, words().alias("size"), members.alias("members")).withColumn("place", F.xxhash64(F.lit(SEED), "doc_id", "size"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, share: Fraction = SHARE, members: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, members, size, source_size, target, taken) of every document, and the row's number where it has one.

    ``taken`` is a whole number of passes over the document, in words. source_size and target
    are those of the document's first source. Weights default to CYCLE over the sources in
    order of code points, null last.
    """
    rows = store(sized(docs, members), "mixing")
    patterns = [(tuple(r["members"] or ()), r["size"]) for r in rows.groupBy("members").agg(F.sum("size").alias("size")).collect()]
    patterns.sort(key=lambda p: [(m is None, (m or "").encode("utf-32-be")) for m in p[0]])
    names = sorted({m for p, _ in patterns for m in p}, key=lambda m: (m is None, (m or "").encode("utf-32-be")))
    number = {m: k for k, m in enumerate(names)}
    sizes = [sum(size for p, size in patterns if m in p) for m in names]
    shares = [Fraction(CYCLE[k % len(CYCLE)]) if weights is None else Fraction(weights.get(m, 0)) for k, m in enumerate(names)]
    wanted = targets(sizes, shares, share * sum(size for _, size in patterns), limit)
    routed = flow([(tuple(number[m] for m in p), size) for p, size in patterns], [int(t) for t in wanted], limit)
    spark = docs.sparkSession
    table = []
    for (p, size), out in zip(patterns, routed, strict=True):
        words_, first = sum(out.values()), number[p[0]] if p else None
        whole, part = divmod(words_, size) if size else (0, 0)
        table.append((list(p), whole, part, sizes[first] if p else 0, float(wanted[first]) if p else 0.0))
    plan = spark.createDataFrame(table, "members array<string>, whole long, part long, source_size long, target double")
    rows = rows.join(F.broadcast(plan), "members")  # a row for each pattern; arrays of nulls are equal

    # The part of a pass: documents in seeded order as long as they fit; what is then missing is
    # less than the next document, and smaller ones after it fill that, a few times over.
    rows = rows.withColumn("more", F.lit(False))
    parts = {tuple(p): part for p, _, part, _, _ in table if part}
    for _ in range(FILLS):
        if not parts:
            break
        gaps = spark.createDataFrame([(list(p), gap) for p, gap in parts.items()], "members array<string>, gap long")
        rows = store(_fill(rows, gaps), "mixing")
        taken = rows.where("added > 0").groupBy("members").agg(F.sum("added").alias("n")).collect()
        parts = {p: gap - n for r in taken if (gap := parts.get(p := tuple(r["members"]))) is not None and gap > (n := r["n"])}
        rows = rows.drop("added")
    row = [ROW] if ROW in rows.columns else []
    return rows.select("doc_id", *row, "members", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more").cast("long"))).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Documents as often as the mix takes them, with their columns.

    Each row is a document of its own, whatever its doc_id: rows meet by number. Documents without words have nothing to repeat and stay as they are.
    """
    rows = numbered(docs, "mixing-rows")
    passes = mix(rows, **options).select(ROW, F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1).cast("int").alias(TURNS)).where(F.col(TURNS) > 0)
    rows = rows.join(bounded(store(passes, "mixing-passes")), ROW)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(TURNS))).alias(TURN)).drop(TURN)


def _fill(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Mark documents, in seeded order, as long as their sizes stay within their pattern's gap; added is what that adds."""
    rows = rows.join(F.broadcast(gaps), "members", "left").withColumn("range", F.shiftrightunsigned("place", 64 - RANGE_BITS))
    rows = rows.withColumn("open", F.coalesce(~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col("gap")), F.lit(False)))
    sums = rows.where("open").groupBy("members", "range", "gap").agg(F.sum("size").alias("n"))
    run = F.sum("n").over(Window.partitionBy("members").orderBy("range"))
    # the first range that does not fit whole; a pattern that fits whole has none
    cut = sums.withColumn("upto", run).where("upto > gap").groupBy("members").agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    rows = rows.join(F.broadcast(cut), "members", "left")  # a row for each pattern
    order = ["place", "doc_id", "size", *([ROW] if ROW in rows.columns else [])]
    inside = F.sum("size").over(Window.partitionBy("members", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where("open and range = cut.range").withColumn("fits", F.col("cut.before") + inside <= F.col("gap"))
    rest = rows.where("not open or cut is null or range != cut.range").withColumn("fits", F.expr("open and (cut is null or range < cut.range)"))
    return rest.unionByName(edge).withColumn("added", F.when(F.col("fits"), F.col("size")).otherwise(0)).withColumn("more", F.col("more") | F.col("fits")).drop("gap", "range", "open", "cut", "fits")
