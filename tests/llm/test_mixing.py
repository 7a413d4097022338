import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing
from lectern.llm.entry import source_weights

SCHEMA = "doc_id bigint, text string, source string, size string"


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, report = mixing.mix(docs, F.array("source"), source_weights)
    return out.collect(), report


def test_targets_share_the_excess():
    got = mixing.targets({"a": 10, "b": 100, "c": 90}, {"a": 5, "b": 2, "c": 1}, 200, 3)
    assert got == pytest.approx({"a": 30, "b": 170 * 2 / 3, "c": 170 / 3})
    assert mixing.targets({}, {}, 0, 3) == {}
    assert mixing.targets({"a": 0}, {"a": 1}, 0, 3) == {"a": 0}


def test_flow_fills_quotas_and_spreads_repeats():
    capacity = {("a",): 10, ("b",): 10, ("a", "b"): 10}
    got = mixing.min_cost_flow(capacity, {"a": 20, "b": 20}, 3)
    of = lambda s: sum(n for (_, x), n in got.items() if x == s)
    assert of("a") == 20 and of("b") == 20
    used = Counter()
    for (p, _), n in got.items():
        used[p] += n
    # 40 words out of 30: every pattern is used once before any is used twice
    assert all(used[p] >= 10 for p in capacity) and max(used.values()) <= 20


def test_taken_nears_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "abc"[i % 3] if i % 10 else None, "clash") for i in range(3000)]
    got, report = mixed(spark, rows)
    assert len(got) == 3000
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == words[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert set(report) == {"a", "b", "c", None}
    for s, x in report.items():
        assert x["routed"] == round(x["target"]) and x["size"] == sum(words[r[0]] for r in rows if r[2] == s)
        assert abs(taken[s] - x["target"]) <= 50
    again, _ = mixed(spark, rows[::-1])
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in got}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "a", None), (2, "", "a", None), (None, "x y", None, None), (3, "x y", None, None), (3, "x y", None, None)]
    got, report = mixed(spark, rows)
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2] and report["a"]["size"] == 0
    assert report[None]["target"] == 6 and sum(r["taken"] for r in got) == 6
    got, report = mixed(spark, [])
    assert got == [] and report == {}


def test_flow_against_all_allocations():
    """Every way to route whole words, on small graphs: most words first, then
    least cost, a pattern's k-th repetition of its words costing k a word."""
    rng = random.Random(8)
    for _ in range(30):
        sources = "abc"[: rng.randint(1, 3)]
        patterns = rng.sample([p for n in (1, 2, 3) for p in itertools.combinations(sources, n)], k=min(2, 2 ** len(sources) - 1))
        capacity, quota = {p: rng.randint(0, 3) for p in patterns}, {s: rng.randint(0, 5) for s in sources}
        arcs = [(p, s) for p in patterns for s in p]
        best = None
        for flow in itertools.product(*(range(min(2 * capacity[p], quota[s]) + 1) for p, s in arcs)):
            used, into = Counter(), Counter()
            for (p, s), n in zip(arcs, flow, strict=True):
                used[p] += n
                into[s] += n
            if all(used[p] <= 2 * capacity[p] for p in patterns) and all(into[s] <= quota[s] for s in sources):
                cost = sum(max(0, used[p] - capacity[p]) for p in patterns)
                best = min(best or (0, 99), (-sum(flow), cost))
        got = mixing.min_cost_flow(capacity, quota, 2)
        used = Counter()
        for (p, _), n in got.items():
            used[p] += n
        assert (-sum(got.values()), sum(max(0, used[p] - capacity[p]) for p in patterns)) == best


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i * 11 % 37), ["a", "b"] if i % 4 == 0 else ["a"] if i % 2 else ["b"]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, m array<string>")
    out, report = mixing.mix(docs, F.col("m"), lambda s: [3, 1], total=9000)
    taken = sum(r["taken"] for r in out.collect())
    assert {s: x["routed"] for s, x in report.items()} == {"a": 6750, "b": 2250} and abs(taken - 9000) <= 3


def test_a_very_long_text_at_the_cut_leaves_no_gap(spark, monkeypatch):
    rng = random.Random(9)
    for bucket in (8192, 256, 128):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        rows = [(i, "w " * (5000 if i % 100 == 0 else rng.randint(1, 60)), "abcd"[i % 4], "") for i in range(1200)]
        got, report = mixed(spark, rows)
        taken = Counter()
        for r in got:
            taken[r["source"]] += r["taken"]
        for s, x in report.items():
            assert -1 < x["target"] - taken[s] < 12, (bucket, s, x, taken[s])


def test_clashing_columns_and_too_many_patterns(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8)], "doc_id int, text string, source string, __q int, COPIES int")
    out, _ = mixing.mix(docs, F.array("source"), source_weights)
    assert out.columns == ["doc_id", "text", "source", "__q", "size", "taken", "copies"] and out.first()["__q"] == 7
    monkeypatch.setattr(mixing, "PATTERNS", 0)
    with pytest.raises(ValueError):
        mixing.mix(docs, F.array("source"), source_weights)
