"""Mixing sources to target weights: min-cost flow from membership patterns to
source quotas, with convex repetition costs, then seeded selection."""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Guard, quoted

OUT = ("size", "taken", "copies")
#: Rows that are ordered together when a pattern's last documents are chosen, about.
BUCKET_ROWS = 8192
#: Membership patterns that the driver plans for at most; more are an error.
PATTERNS = 100_000
#: Times that documents which still fit are sought for what is left of a pattern's flow.
FILLS = 4


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of total by weight; none above most times its size, the excess
    shared among the others by weight until none is above."""
    fixed: dict = {}
    while free := [s for s in sizes if s not in fixed]:
        left, w = total - sum(fixed.values()), sum(weights[s] for s in free)
        share = {s: left * weights[s] / w if w else 0.0 for s in free}
        if not (over := [s for s in free if share[s] > most * sizes[s]]):
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}
    return fixed


def min_cost_flow(capacity: dict, quota: dict, most: int) -> dict:
    """Whole words that each pattern gives each of its sources.

    Arcs: pattern to source where the pattern holds the source; a pattern's
    k-th repetition of its words costs k (convex, so repeats are a last resort
    and spread evenly). Successive shortest paths with potentials. The graph is
    as large as the number of patterns and sources, whatever the rows; a pattern
    and its only source that share no other arc need no search.
    """
    holders = Counter(s for p in capacity for s in dict.fromkeys(p))
    alone = {(p, p[0]): min(quota[p[0]], most * size) for p, size in capacity.items() if len(set(p)) == 1 and holders[p[0]] == 1}
    settled = {s for _, s in alone}
    capacity = {p: size for p, size in capacity.items() if p and (p, p[0]) not in alone}
    quota = {s: q for s, q in quota.items() if s not in settled}
    graph: list[list[list]] = []  # node -> [to, room, cost, place of the reverse arc]

    def node() -> int:
        graph.append([])
        return len(graph) - 1

    def arc(u: int, v: int, room: int, cost: int) -> list:
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])
        return graph[u][-1]

    start, end = node(), node()
    sinks = {s: node() for s in quota}
    for s, q in quota.items():
        arc(sinks[s], end, q, 0)
    kept = {}
    for p, size in capacity.items():
        at = node()
        for k in range(most):
            arc(start, at, size, k)
        for s in dict.fromkeys(p):
            kept[p, s] = arc(at, sinks[s], most * size, 0)
    potential = [0] * len(graph)
    while True:
        far, via, queue = {start: 0}, {}, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for i, (v, room, cost, _) in enumerate(graph[u]):
                if room and (x := d + cost + potential[u] - potential[v]) < far.get(v, math.inf):
                    far[v], via[v] = x, (u, i)
                    heapq.heappush(queue, (x, v))
        if end not in far:
            break
        longest = max(far.values())
        potential = [p + far.get(i, longest) for i, p in enumerate(potential)]
        room, v = math.inf, end
        while v != start:
            u, i = via[v]
            room, v = min(room, graph[u][i][1]), u
        v = end
        while v != start:
            u, i = via[v]
            graph[u][i][1] -= room
            graph[v][graph[u][i][3]][1] += room
            v = u
    return alone | {k: most * capacity[k[0]] - a[1] for k, a in kept.items()}


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, members: Column, weights_of, total: float | None = None, most: int = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """docs plus size (words), taken (size x copies) and copies (0 to most);
    and per source its size, target and routed words.

    members: array of the sources that a document belongs to. weights_of: from
    the list of sources (by code point, null last) to a weight for each. total:
    words to mix, all there are by default. A pattern takes its whole documents
    evenly often, and some one time more, as its flow still needs: in a seeded
    order up to the first that is too large, then again from those that fit what
    is left, FILLS times, and at last the largest that fits.

    Defined results: a null text has size 0; a null source is a source like any
    other; documents without members, or of size 0, are not taken beyond the
    even copies; repeated rows count each, ties in the order by id, size and a
    hash of the text; texts of any length count whole; an empty table gives an
    empty table; an input column named like an output is replaced. The driver
    holds one row a pattern, none a document; more than PATTERNS are an error.

    Skew: a pattern is cut into buckets of about BUCKET_ROWS by its seeded order
    (of id and text, so rows without an id are spread too), and only bucket sums
    meet. Fills look at the bucket where the order is cut and the next.
    """
    text = F.xxhash64(quoted(text_col))
    safe = Guard(docs, OUT, q=F.coalesce(members, F.array().cast("array<string>")), x=text, o=F.xxhash64(quoted(id_col), text, F.lit(seed)), id=quoted(id_col), size=words(quoted(text_col)))
    rows = safe.rows.withColumnRenamed("__size", "size")
    summed = rows.groupBy("__q").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(PATTERNS + 1).collect()
    if len(summed) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    capacity = {tuple(r["__q"]): r["size"] for r in summed}
    sources = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    sizes = Counter()
    for p, size in capacity.items():
        sizes.update({s: size for s in set(p)})
    wanted = targets(sizes, dict(zip(sources, weights_of(sources), strict=True)), sum(capacity.values()) if total is None else total, most)
    flow = min_cost_flow(capacity, {s: round(x) for s, x in wanted.items()}, most)
    given, routed = Counter(), Counter()
    for (p, s), n in flow.items():
        given[p] += n
        routed[s] += n
    report = {s: {"size": sizes[s], "target": wanted[s], "routed": routed[s]} for s in sources}

    # one row a pattern, so PATTERNS at most
    bits = lambda n: max(0, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS)))
    plan = [(list(p), given[p] // max(size, 1), given[p] % max(size, 1)) for p, size in capacity.items()]
    plan = docs.sparkSession.createDataFrame(plan, "__q array<string>, __even bigint, __rest bigint")
    cut = docs.sparkSession.createDataFrame([(list(r["__q"]), 64 - bits(r["n"])) for r in summed if bits(r["n"])], "__q array<string>, __shift int")
    rows = rows.join(F.broadcast(cut), "__q", "left")
    rows = rows.withColumn("__b", F.coalesce(F.call_function("shiftrightunsigned", F.col("__o"), F.col("__shift")), F.lit(0).cast("long")))
    ahead = Window.partitionBy("__q").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("__q", "__b").agg(F.sum("size").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)))
    buckets = buckets.join(F.broadcast(plan), "__q").withColumn("__room", F.col("__rest") - F.col("__before"))
    # the bucket after the one where the order is cut goes with it, for fills
    in_order = Window.partitionBy("__q").orderBy("__b")
    earlier = {c: F.lag(c).over(in_order) for c in ("__b", "__room", "__sum")}
    goes_with = (earlier["__room"] >= 0) & (earlier["__room"] < earlier["__sum"])
    buckets = buckets.select("__q", "__b", "__even", F.when(goes_with, earlier["__b"]).otherwise(F.col("__b")).alias("__g"), F.when(goes_with, earlier["__room"]).otherwise(F.col("__room")).alias("__room"))
    alone = Window.partitionBy("__q", "__g")
    ordered = alone.orderBy("__o", "__id", "size", "__x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(buckets, ["__q", "__b"]).withColumn("__took", F.lit(False))
    for _ in range(1 + FILLS):
        # what is left is never more than room, so later buckets (room < 0) take none
        rows = rows.withColumn("__fits", ~F.col("__took") & (F.col("size") <= F.col("__room")) & (F.col("size") > 0))
        rows = rows.withColumn("__run", F.sum(F.when(F.col("__fits"), F.col("size")).otherwise(0)).over(ordered))
        rows = rows.withColumn("__new", F.col("__fits") & (F.col("__run") <= F.col("__room")))
        rows = rows.withColumn("__room", F.col("__room") - F.sum(F.when(F.col("__new"), F.col("size")).otherwise(0)).over(alone))
        rows = rows.withColumn("__took", F.col("__took") | F.col("__new"))
    filler = ~F.col("__took") & (F.col("size") <= F.col("__room")) & (F.col("size") > 0)
    largest = alone.orderBy(filler.cast("int").desc(), F.col("size").desc(), "__o", "__id", "__x")
    extra = (F.col("__took") | (filler & (F.row_number().over(largest) == 1))).cast("int")
    out = rows.withColumn("copies", F.least(F.col("__even") + extra, F.lit(most).cast("long")))
    return safe.back(out.withColumn("taken", F.col("size") * F.col("copies"))), report
