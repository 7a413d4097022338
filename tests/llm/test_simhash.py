import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash as S
from lectern.llm.components import components


def plain_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def group(prints, distance=2):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = ["", None, "  \n", "one", "One", "one two", "ONE\ttwo", "A b c", "é à ß Ü", "x " * 5000, "solo" * 30_000]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([10, 150, 400]))]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edit"
            out.append(" ".join(copy))
    return out


def test_fingerprint_and_groups_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(500, "one")]
    got = {r.doc_id: r for r in S.simhash(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == group(prints)


def test_spark_hash_is_the_same_hash(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("ab cd é")).alias("h")).first()
    assert r.h % 2**64 == xxhash.xxh64_intdigest("ab cd é".encode(), 42)


def test_search_finds_every_pair_in_dense_buckets(spark):
    """Hundreds of fingerprints that differ in few bits, with a bucket limit that
    makes the search split its buckets again and again."""
    rng = random.Random(3)
    values = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(250):
            values.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))))
    values |= {rng.getrandbits(64) for _ in range(300)}
    signed = [v - (v >> 63 << 64) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert {(r.u, r.v) for r in S.links(df, bucket=16).collect()} == want
    assert {(r.u, r.v) for r in S.links(df).collect()} == want


def test_unequal_thresholds():
    cost = [{-1: 0.0, 0: 100.0, 1: 1e6, 2: 1e9}, {-1: 0.0, 0: 1.0, 1: 5.0, 2: 1e5}, {-1: 0.0, 0: 3.0, 1: 1e5, 2: 1e7}]
    assert S.allocate(cost, 3) == (8.0, [-1, 1, 0])


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64)).astype(float)
    for j in range(1, 20):
        bits[:, 3 * j % 64] = bits[:, 0]
    groups = S.correlated_groups(bits.T @ bits, 4000, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert len(set(groups[0]) & {3 * j % 64 for j in range(20)}) >= 19


def test_dedup_edge_cases(spark):
    schema = "doc_id bigint, text string, fingerprint int"
    rows = [(3, "a b c d", 1), (1, "a b c d", 1), (None, "a b c d", 1), (2, None, 1), (4, "", 1), (3, "a b c d", 1)]
    df = spark.createDataFrame(rows, schema)
    got = [(r.doc_id, r.component_id) for r in S.simhash(df).collect()]
    assert sorted(got, key=str) == sorted([(3, 1), (1, 1), (None, 1), (2, 2), (4, 2), (3, 1)], key=str)
    left = S.simhash_dedup(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "None"]
    assert S.simhash(df.limit(0)).collect() == [] and S.simhash_dedup(df.limit(0)).collect() == []


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    some = [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(50)]
    links = path + star + some + [(7, 7)]
    rng.shuffle(links)
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def five_words(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_similarity(rows, least=0.8):
    """The smallest id of each group, by comparing all pairs."""
    sets, root = {i: five_words(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, _) in enumerate(rows):
        for b, _ in rows[:n]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both >= least * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def similar_texts():
    """Copies edited in up to every twelfth word, chains of edits, one large
    group, and texts that share a long passage only."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    passage, out = rng.choices(words, k=60), ["", "one", "a b c d e f", "A b c d e f", " a b c d e f g h i j", "a b c d e f g h i k", "x " * 300]
    for k in range(24):
        base = rng.choices(words, k=rng.choice([8, 60, 200, 600])) + passage * (k % 3 == 0)
        out.append(" ".join(base))
        for _ in range(4):
            for _ in range(rng.randrange(1, max(2, len(base) // 30))):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
    big = rng.choices(words, k=250)
    for _ in range(150):
        copy = list(big)
        copy[rng.randrange(250)], copy[rng.randrange(250)] = rng.choices(words, k=2)
        out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def test_similarity_against_all_pairs(spark):
    import corpus_pipeline

    rows = similar_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = by_similarity(rows)
    full = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    left = corpus_pipeline.drop_near_copies(spark, full, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_similarity_edge_cases(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (4, ""), (3, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id) for r in S.simhash(df, shingle=5, similarity=0.8).collect()]
    assert sorted(got, key=str) == sorted([(3, 1), (1, 1), (None, 1), (2, 2), (4, 2), (3, 1)], key=str)
    assert S.simhash_dedup(df.limit(0), shingle=5, similarity=0.8).collect() == []


def test_similarity_whatever_the_fingerprints(spark):
    """No pair is left out for its fingerprints, nor for the probes looked at first."""
    rows = similar_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.simhash(df, distance=0, shingle=5, similarity=0.8).collect()}
    assert got == by_similarity(rows)
    none = np.array([], np.int64)
    assert len(S._probes(np.arange(1000), none, none, 0.8)[0]) == 201


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (0, 5, 300, 5000):
        both, a, b = (rng.integers(-(2**63), 2**63, size=k) for k in (n, n // 5, n // 7))
        x, y = S.parities(np.concatenate((both, a))), S.parities(np.concatenate((both, b)))
        apart = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert apart <= len(a) + len(b) and (n == 0 or n == 5000 or apart > 0)


def test_prefixes_of_similar_sets_share_enough(spark):
    """Of random sets at and about the similarity, with every order of shingles."""
    rng, found = np.random.default_rng(6), []
    for _ in range(3000):
        common = np.unique(rng.integers(0, 5000, size=400))
        seen = rng.integers(0, 4, size=len(common))
        pool = rng.permutation(5000)
        both, a, b = rng.integers(1, 200), *rng.integers(0, 30, size=2)
        x, y = np.sort(pool[: both + a]), np.sort(np.concatenate((pool[:both], pool[both + a : both + a + b])))
        if both >= 0.8 * (both + a + b) - 1e-9:
            prefixes = [S._probes(s, common, seen, 0.8)[0] for s in (x, y)]
            found.append((len(x), len(y), len(np.intersect1d(*prefixes))))
    df = spark.createDataFrame([tuple(map(int, f)) for f in [*found, (0, 0, 1)]], "n bigint, o bigint, shared bigint")
    spare = [r[0] for r in df.select(F.col("shared") - S.least_shared(F.col("n"), F.col("o"), 0.8)).collect()]
    assert len(spare) > 1000 and min(spare) == 0


def test_bitmap_leaves_out_no_shingle(spark):
    rng = np.random.default_rng(7)
    for n in (0, 1, 5000):
        some = np.unique(rng.integers(-(2**63), 2**63 - 1, size=n))
        bits = S.bitmap(spark.createDataFrame([(int(t),) for t in some], "t bigint"))
        others = rng.integers(-(2**63), 2**63 - 1, size=100_000)
        assert S._kept(some, bits).all() and S._kept(others, bits).mean() < 0.08


def test_similarity_with_many_open_shingles_and_repeats(spark, monkeypatch):
    """Open shingles found by a shuffle, a bitmap with most bits set, repeated rows."""
    monkeypatch.setattr(S, "OPEN", 0)
    monkeypatch.setattr(S, "SPARSE", 0)
    rows = similar_texts()
    rows += [(len(rows) + i, t) for i, t in rows[::7]] + [(5000 + i, rows[3][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.simhash(df, distance=0, shingle=5, similarity=0.8).collect()}
    assert got == by_similarity(rows)


def shuffled(spark):
    """MB that all stages so far have shuffled."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def test_similarity_shuffles_little(spark, monkeypatch):
    """Texts that share a passage each with another one: neither their features nor
    the shingles that nothing shares go through a shuffle again."""
    monkeypatch.setattr(S, "OPEN", 0)
    rng, rows = random.Random(8), []
    for i in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        if i % 2:
            words[:60] = rows[-1][1].split()[:60]
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).createOrReplaceTempView("rows")
    df = S.checkpointed(spark.table("rows"))
    before = shuffled(spark)
    assert S.simhash_dedup(df, distance=26, shingle=5, similarity=0.8).count() == len(rows)
    assert shuffled(spark) - before < 15.5
