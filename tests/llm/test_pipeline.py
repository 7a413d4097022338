import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from lectern.llm import toxicity

CLEAN = "the river ran past a quiet mill and the miller counted sacks of grain by the old door near town".split()


def corpus():
    """Rows of every kind that a stage decides on, and labels for some."""
    rng, out, labels = random.Random(11), [], []
    add = lambda text, source="a": out.append((len(out), text, "en", source, len(text or ""))) or len(out) - 1
    for i in range(300):
        text = " ".join(rng.choices(CLEAN, k=rng.randint(20, 60)) + [f"w{i}x{j}" for j in range(15)]) + "."
        if i % 5 == 0:
            text += " you vile grubworm go away now."
        labels.append((add(text, "abc"[i % 3]), 1, int(i % 5 == 0)))
    for i in range(40):
        words = [f"{rng.choice(CLEAN)}{rng.randint(0, 99)}" for _ in range(60)]
        add(" ".join(words), "b")
        add(" ".join(words).upper(), "c")  # an exact copy
        words[30] = "changed"
        add(" ".join(words), "a")  # a near copy: 5 of 56 shingles differ
        words[10:40] = words[10:40][::-1]
        add(" ".join(words), None)  # neither
    for text in (None, "", "", " \n", "grain " * 30_000):
        add(text, "c")
    return out, labels


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) <= 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(rows):
    """Smallest id of each group: all pairs compared; texts without words are alike."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, docs, seen = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.collect())
    clean, unique, apart, mixed, encoded = seen
    text = {r[0]: r[1] for r in rows}

    assert {r["doc_id"] for r in clean} == {i for i, t in text.items() if model.document(t or "")[0] < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in clean} == set(text) - {i for i, _, y in labels if y}

    last = {}
    for r in clean:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in unique) == sorted(last.values())

    groups = near_groups([(r["doc_id"], r["text"]) for r in unique])
    assert sorted(r["doc_id"] for r in apart) == sorted(i for i, g in groups.items() if i == g)
    assert len(apart) < len(unique)

    copies, sizes, taken = Counter(r["doc_id"] for r in mixed), Counter(), Counter()
    for r in apart:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
    assert set(copies) <= {r["doc_id"] for r in apart} and max(copies.values()) <= 3
    left, free, weights, target = sum(sizes.values()), set(sizes), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5), strict=True)), {}
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3 * sizes[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    assert all(abs(taken[s] - target[s]) <= 30_000 * (s == "c") + 60 for s in sizes), (taken, target)

    assert Counter(r["doc_id"] for r in encoded) == copies
    assert all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in encoded)
