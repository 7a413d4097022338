"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a
Hamming distance by a generalised pigeonhole search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, attach, checkpointed, quoted, release, small_side, unused
from .components import components

OUT = ("fingerprint", "component_id")
BITS, SHINGLE, DISTANCE, SEED = 64, 3, 2, 42
#: A bucket with more fingerprints is split by further bits. Five splits leave
#: fewer than nine free bits, so no bucket can stay larger.
BUCKET = 512
#: By similarity: sets with fewer shingles are compared whatever their fingerprints.
FEW = 64
#: One text in so many (all of a small table) tells which shingles are common, and
#: how many of these, the most frequent ones, are sent to all tasks (4 MB).
ORDER_SHARE, SMALL, COMMON = 8, 4096, 1 << 18
#: Rare shingles by which a text looks for similar ones at first.
PROBES = 24
#: Bits of a set's parities, and open shingles that may be broadcast.
PARITIES, OPEN = 2048, 1 << 18
#: Bits a shingle in a bitmap of shingles, and bits that a bitmap has at most (16 MB).
SPARSE, BITMAP = 16, 1 << 27
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text (0 without words): words are runs of
    non-space ASCII-lower-cased bytes; each shingle counts, repeats included."""
    return majority(shingles(text, shingle))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in order; of all its words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The signed SimHash of hashes, 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp of every row (ids are longs)."""
    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).mapInArrow(lambda x: _fingerprints(x, shingle), "id bigint, fp bigint")


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, both = 0, np.zeros((BITS, BITS))
    for batch in batches:
        bits = np.unpackbits(batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        seen, both = seen + len(bits), both + bits.T @ bits
    flat = np.concatenate(([seen], both.ravel())).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.int64())], names=["k", "n"])


def correlated_groups(together: np.ndarray, total: int, groups: int) -> list[list[int]]:
    """Bits (0 is the highest) in groups of about equal size, the most
    correlated ones in one group. together: how often both of two bits are set."""
    p = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    strength = np.abs(np.divide(together / max(total, 1) - np.outer(p, p), spread, out=np.zeros_like(spread), where=spread > 0))
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for k in range(groups):
        size = (BITS - sum(map(len, out))) // (groups - k)
        free = sorted(left)
        group = [free[int(strength[np.ix_(free, free)].sum(1).argmax())]]
        while len(group) < size:
            free = sorted(left - set(group))
            group.append(free[int(strength[np.ix_(free, group)].mean(1).argmax())])
        left -= set(group)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], spare: int) -> tuple[float, list[int]]:
    """The cheapest threshold for each part, -1 for a part not probed, where
    sum(threshold + 1) = spare: by the generalised pigeonhole principle, a pair
    within spare - 1 bits is within its threshold in one part at least.
    Dynamic programming over parts; costs: per part, by threshold."""
    best = {0: (0.0, [])}
    for part in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, taken) in best.items():
            for t, c in part.items():
                if used + t + 1 <= spare and (at := used + t + 1) not in new or used + t + 1 <= spare and cost + c < new[at][0]:
                    new[used + t + 1] = (cost + c, [*taken, t])
        best = new
    return best[spare]


def _mask(bits: list[int]) -> int:
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (value >> 63 << 64)


def _flips(bits: list[int], errors: int) -> list[int]:
    """Masks that flip up to errors of the bits."""
    out, last = [0], [(0, 0)]
    for _ in range(errors):
        last = [(m | 1 << (BITS - 1 - bits[j]), j + 1) for m, i in last for j in range(i, len(bits))]
        out += [m for m, _ in last]
    return [m - (m >> 63 << 64) for m in out]


def plan_parts(prints: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) for each part to probe, from counts over all distinct
    fingerprints: pairs of bits set together give the groups, and how many
    fingerprints share a part's value gives each threshold's estimated
    candidates. The driver receives counts per bit pair and per part only."""
    counts = {r["k"]: r["n"] for r in prints.select("fp").mapInArrow(_set_bits, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(0, 0)
    together = np.array([counts.get(1 + k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)
    layouts = [correlated_groups(together, total, m) for m in range(2, distance + 2)]
    parts = [(i, g, group) for i, groups in enumerate(layouts) for g, group in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(100 * i + g).alias("part"), F.col("fp").bitwiseAND(_mask(group)).alias("value")) for i, g, group in parts]))
    same = {r["part"]: float(r["pairs"]) for r in prints.select(keys.alias("k")).groupBy("k.part", "k.value").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    p = np.diag(together) / max(total, 1)
    plans = []
    for i, groups in enumerate(layouts):
        costs = []
        for g, group in enumerate(groups):
            near = [(2 * p[b] * (1 - p[b])) / max(1 - 2 * p[b] * (1 - p[b]), 1e-9) for b in group]
            candidates, probes, cost = same.get(100 * i + g, 0.0), 1, {-1: 0.0}
            for t in range(distance + 1):
                probes = len(_flips(group, t))
                growth = sum(sum(near) ** k / max(1, k) for k in range(1, t + 1))
                cost[t] = 20.0 * total * probes + candidates * (1 + growth)
            costs.append(cost)
        plans.append((*allocate(costs, distance + 1), groups))
    _, thresholds, groups = min(plans, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]


def _pairs(rows: DataFrame, distance: int) -> DataFrame:
    probe, index = rows.where("probe").select("key", F.col("fp").alias("u")), rows.where("stored").select("key", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    return probe.join(index, "key").where(near).select("u", "v")


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """u < v: all pairs of distinct fingerprints (column fp) within distance
    bits, some of them more than once.

    Every fingerprint is stored under its value in each part, and probes the
    values within the part's threshold; pairs that meet in a bucket are verified
    in full. A bucket of more than BUCKET stored fingerprints (near copies by the
    thousand) joins no pairs: its rows go to three sub-buckets by their bits not
    yet used, and a pair within two bits still agrees in one of the three. That
    repeats until all buckets are small, so nothing is capped and no group emits
    all its pairs.
    """
    parts = plan_parts(prints, distance)
    made, unused = [], {}
    for k, (bits, t) in enumerate(parts):
        unused[k] = [b for b in range(BITS) if b not in bits]
        for flip in _flips(bits, t):
            made.append(F.struct(F.lit(k).alias("path"), F.lit(flip == 0).alias("stored"), F.lit(True).alias("probe"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(_mask(bits)).bitwiseXOR(F.lit(flip))).alias("key")))
    rows = prints.select("fp", F.explode(F.array(*made)).alias("m")).select("fp", "m.*")
    found = None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stored").cast("long")).alias("size"))
        rows = checkpointed(attach(rows, sizes, ["key"], ["size"], "n", ["fp"]).select("fp", "path", "stored", "probe", "key", "size"))
        cold = _pairs(rows.where(F.col("size") <= bucket), distance)
        found = cold if found is None else found.unionByName(cold)
        hot = rows.where(F.col("size") > bucket)
        paths = [r["path"] for r in hot.select("path").distinct().collect()]
        if not paths or all(len(unused[p]) <= distance for p in paths):
            return found.unionByName(_pairs(hot, distance)) if paths else found
        made, after = F.array().cast("array<struct<path:int,key:bigint>>"), {}
        for p in paths:
            groups = [unused[p][g :: distance + 1] for g in range(distance + 1)]
            new = []
            for group in groups:
                q = len(after)
                after[q] = [b for b in unused[p] if b not in group]
                new.append(F.struct(F.lit(q).alias("path"), F.xxhash64("key", F.lit(q), F.col("fp").bitwiseAND(_mask(group))).alias("key")))
            made = F.when(F.col("path") == p, F.array(*new)).otherwise(made)
        unused = after
        rows = hot.select("fp", "stored", "probe", F.explode(made).alias("m")).select("fp", "stored", "probe", "m.*")


def near_groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, component_id, n for each distinct fp of prints (id, fp): the smallest
    id reachable by links, itself included, and how many rows have that fp."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    linked = components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    grouped = distinct.join(linked, "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    smallest = grouped.groupBy("c").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    return attach(grouped.select("c", "fp", "n"), smallest, ["c"], ["component_id"], "m", ["fp"]).select("fp", "component_id", "n")


def _order(tokens: np.ndarray, common: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """tokens by how often they were seen among the common ones (sorted), then by
    value; and how many were never seen."""
    if not len(common):
        return np.sort(tokens), len(tokens)
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    times = np.where(common[at] == tokens, seen[at], 0)
    return tokens[np.lexsort((tokens, times))], int((times == 0).sum())


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _probes(tokens: np.ndarray, common: np.ndarray, seen: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The shingles by which a set meets similar ones, rare ones first: the prefix
    of which any two such sets share one; and how many of them to look at first:
    PROBES where half of a set or more is rare, else all. Empty sets, alike all,
    meet by a probe of 0."""
    if not len(tokens):
        return np.zeros(1, np.int64), 1
    need = len(tokens) - math.ceil(similarity * len(tokens) - 1e-9) + 1
    ordered, rare = _order(tokens, common, seen)
    return ordered[:need], min(need, PROBES) if 2 * rare >= len(tokens) else need


def parities(tokens: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall to each of PARITIES places, modulo two, as
    longs. Two sets differ in at least as many shingles as their parities do in bits."""
    odd = np.bincount((tokens.view(np.uint64) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_shared(n: Column, o: Column, similarity: float) -> Column:
    """How many shingles of their prefixes two similar sets of n and o shingles
    share at least. Of the set whose prefix ends first, in the order of all, a
    shingle of the prefix that isn't in the other prefix isn't in the other set
    at all: the sets share no more than their prefixes do and what follows it."""
    both = F.ceil(similarity / (1 + similarity) * (n + o) - 1e-6)
    return both - F.ceil(similarity * F.greatest(n, o) - 1e-9) + 1


def once(rows: DataFrame) -> DataFrame:
    """rows (checkpointed), one for each node; only those that repeat are shuffled."""
    again = checkpointed(rows.groupBy("node").count().where("count > 1").select("node"))
    if again.isEmpty():
        return rows
    again = small_side(again)
    return checkpointed(rows.join(again, "node", "left_anti").unionByName(rows.join(again, "node", "left_semi").dropDuplicates(["node"])))


def bitmap(tokens: DataFrame) -> np.ndarray:
    """A bitmap (a power of two of bits, as bytes) with the bits set that tokens
    (t: longs, checkpointed) have by _kept; BITMAP bits at most, whatever their number."""
    bits = min(BITMAP, 1 << max(15, (SPARSE * tokens.count()).bit_length()))
    at = F.col("t").bitwiseAND(F.lit(bits - 1)) + 1
    parts = tokens.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("bytes"))
    out = np.zeros(bits // 8, np.uint8)
    for k, found in parts.toLocalIterator():
        out[(k - 1) * len(found) : k * len(found)] = np.frombuffer(found, np.uint8)
    return out


def _kept(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which tokens a bitmap may have: all that it was made of, and some others."""
    at = tokens & np.int64(8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def similar_links(texts: DataFrame, shingle: int, similarity: float, distance: int) -> tuple[DataFrame, DataFrame]:
    """node, fp of texts (node, text; one node a distinct text), and u, v: links
    between nodes whose sets of shingles have at least that Jaccard similarity.
    Links join the same components as all such pairs would.

    Two such sets share one of the first n - ceil(similarity * n) + 1 shingles in
    any order that all texts use; here those rare in a sample come first, then
    smaller hashes.

    First each text meets the smallest node of each of its probes (some of that
    prefix), if sizes fit and, of FEW or more shingles, fingerprints are within
    distance bits: a large group of near copies needs few comparisons. What that
    leaves out is made up for: all texts in different components that share any
    shingle of their whole prefixes meet, unless sizes, the number of shingles that
    their prefixes share or parities, which are exact bounds, rule them out. All
    candidates are verified by their sets. What a step has shuffled is released
    before the next one.
    """
    spark = texts.sparkSession
    hashed = lambda t: np.unique(shingles(t, shingle)).view(np.int64)

    def tokens(batches):
        for batch in _few(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], names=["node", "tokens"])

    nodes = texts.agg(F.approx_count_distinct("node")).first()[0]
    part = texts if nodes <= SMALL else texts.where(F.pmod(F.xxhash64("node"), F.lit(ORDER_SHARE)) == 0)
    often = part.mapInArrow(tokens, "node bigint, tokens array<bigint>").select(F.explode("tokens").alias("t")).groupBy("t").count().where("count > 2")
    # COMMON pairs of numbers at most, whatever the table holds
    most = often.orderBy(F.desc("count"), "t").limit(COMMON).toArrow().sort_by("t")
    common, seen = most["t"].to_numpy(), most["count"].to_numpy()

    def features(batches):
        for batch in _few(batches):
            sets = [hashed(t.as_py()) for t in batch.column(1)]
            first = [_probes(x, common, seen, similarity) for x in sets]
            odd = [parities(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([majority(x.view(np.uint64)) for x in sets], pa.int64()),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([x for x, _ in first], pa.list_(pa.int64())),
                    pa.array([k for _, k in first], pa.int32()),
                    pa.array([int(np.bitwise_xor.reduce(x)) for x in odd], pa.int64()),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                names=["node", "fp", "n", "first", "k", "fold", "odd"],
            )

    kinds = "node bigint, fp bigint, n bigint, first array<bigint>, k int, fold bigint, odd array<bigint>"
    made = once(checkpointed(texts.mapInArrow(features, kinds)))
    release(spark)
    text = F.struct("node", "n", "fp")
    probes = made.select(text.alias("v"), F.explode(F.slice("first", F.lit(1), F.col("k"))).alias("t"))
    met = probes.groupBy("t").agg(F.min("v").alias("u"), F.count(F.lit(1)).alias("m")).where("m > 1")
    probes = attach(probes, met, ["t"], ["u"], "m", ["v"]).where("u IS NOT NULL").select("u", "v")
    fits = F.least("u.n", "v.n") >= similarity * F.greatest("u.n", "v.n") - 1e-9
    fits &= (F.least("u.n", "v.n") < FEW) | (F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp"))) <= distance)

    def beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        """pairs (u, v) with a and b: the value that table has for each."""
        for c, name in zip("uv", "ab", strict=True):
            known = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("m")).join(table.select(F.col("node").alias(c), F.col(value).alias(name)), c)
            pairs = attach(pairs, known, [c], [name], "m", ["v" if c == "u" else "u"]).drop("__s")
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v; checkpointed) that are similar."""
        wanted = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        sets = once(checkpointed(texts.join(small_side(wanted), "node", "left_semi").mapInArrow(tokens, "node bigint, tokens array<bigint>")))
        release(spark)
        both = F.size(F.array_intersect("a", "b"))
        return checkpointed(beside(pairs, sets, "tokens").where(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("u", "v"))

    stars = probes.where(F.col("u.node") != F.col("v.node")).where(fits).select(F.col("u.node").alias("u"), F.col("v.node").alias("v"))
    stars = checkpointed(stars.distinct())
    del probes, met
    links = verified(stars)
    release(spark)
    joined = checkpointed(components(links).where("node <> component"))
    # shingles that lead to one component only need no further comparison
    placed = made.join(small_side(joined), "node", "left")
    placed = placed.select(F.col("node").alias("v"), F.coalesce("component", "node").alias("c"), "n", "fold", "first")
    probes = placed.select("c", F.explode("first").alias("t"))
    open_ones = probes.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    open_ones = checkpointed(open_ones.select("t", "low", "m"))
    release(spark)
    bits = bitmap(open_ones)

    def maybe_open(batches):
        for batch in _few(batches, 4096):
            ends, all_tokens = np.cumsum(pc.list_value_length(batch.column(4)).to_numpy()), batch.column(4).flatten().to_numpy()
            at = np.flatnonzero(_kept(all_tokens, bits))
            rows = pa.array(np.searchsorted(ends, at, "right"))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:4]), pa.array(all_tokens[at], pa.int64())], names=["v", "c", "n", "fold", "t"])

    probes = placed.mapInArrow(maybe_open, "v bigint, c bigint, n bigint, fold bigint, t bigint")
    if open_ones.limit(OPEN + 1).count() <= OPEN:
        probes = probes.join(F.broadcast(open_ones.select("t")), "t", "left_semi")
    else:
        probes = attach(probes, open_ones, ["t"], ["low"], "m", ["v"]).where("low IS NOT NULL")
    probes = checkpointed(probes.select("t", "v", "c", "n", "fold"))
    release(spark)
    # sets that differ in more shingles than this are less similar
    most_apart = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("o")) + 1e-6
    apart = probes.select("t", F.col("v").alias("u"), F.col("c").alias("d"), F.col("n").alias("o"), F.col("fold").alias("other")).join(probes, "t").where("u < v AND c <> d")
    apart = apart.where(F.least("n", "o") >= similarity * F.greatest("n", "o") - 1e-9).where(F.bit_count(F.col("fold").bitwiseXOR(F.col("other"))) <= most_apart)
    apart = apart.groupBy("u", "v", "o", "n").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared(F.col("n"), F.col("o"), similarity))
    apart = checkpointed(apart.select("u", "v", "o", "n"))
    release(spark)
    ends = checkpointed(apart.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    odd = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = beside(apart, made.join(small_side(ends), "node", "left_semi"), "odd").where(odd <= most_apart).select("u", "v")
    links = links.unionByName(verified(checkpointed(apart)))
    release(spark)
    return made.select("node", "fp"), links


def _similar(docs: DataFrame, id_col: str, text_col: str, distance: int, shingle: int, similarity: float) -> DataFrame:
    """id, fp, component_id for every row, linked by similarity."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), text.alias("text")).withColumn("node", F.xxhash64("text"))
    prints, links = similar_links(rows.select("node", "text"), shingle, similarity, distance)
    counts = rows.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    grouped = checkpointed(counts.join(prints, "node").join(components(links), "node", "left").withColumn("c", F.coalesce("component", "node")))
    smallest = grouped.groupBy("c").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    known = attach(grouped.select("c", "node", "fp", "n"), smallest, ["c"], ["component_id"], "m", ["node"])
    return attach(rows.select("id", "node"), known.select("node", "fp", "component_id", "n"), ["node"], ["fp", "component_id"], "n", ["id"])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id for every row.

    Without similarity, fingerprints within distance bits are linked. With it,
    texts are whose sets of shingles have that Jaccard similarity at least, all of
    them; fingerprints are then over distinct shingles, and distance only says
    which pairs are compared first.

    Defined results: a null or blank text has fingerprint zero and links like
    any other; with fewer words than a shingle the whole sequence is one
    shingle; repeated rows are returned each; null ids are returned, and are a
    component's smallest id only where all its ids are null; other columns are
    ignored; an empty table gives an empty table.
    """
    if similarity is None:
        prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
        found = attach(prints, near_groups(prints, distance), ["fp"], ["component_id"], "n", ["id"])
    else:
        found = _similar(docs, id_col, text_col, distance, shingle, similarity)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs, less all but the smallest id of each component.

    Defined results: rows without an id can't be named as another's copy, and
    stay; so do repeats of the id kept; null and blank texts are copies of each
    other; other columns pass through; an empty table gives an empty table.
    """
    found = simhash(docs, id_col, text_col, distance, shingle, similarity)
    gone = checkpointed(found.where(quoted(id_col) != F.col("component_id")).select(quoted(id_col).alias(unused("gone", docs))).distinct())
    return docs.join(small_side(gone), quoted(id_col) == quoted(gone.columns[0]), "left_anti")
