import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from lectern.llm import sharding

SCHEMA = "doc_id bigint, text string, __b int, SLOT int"


def rendezvous(key, weights):
    score = {i: math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for i, w in enumerate(weights) if w > 0}
    return min(score, key=lambda i: (-score[i], i))


def rows():
    out = [(i, f"text {i % 40}", i, -i) for i in range(2000)]
    return [*out, *out[:30], (None, "a", 1, 1), (None, None, 2, 2), (None, None, 2, 2), (7, "x" * 300_000, 3, 3)]


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 3.0, 0.0, 0.5, 2.0]])
def test_against_brute_force(spark, monkeypatch, weights):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    grown = [*weights, 1.5]
    out = sharding.shard(spark.createDataFrame(rows(), SCHEMA).repartition(5), weights, grown)
    assert out.columns == ["doc_id", "text", "__b", "shard", "slot", "grown_shard"]
    got, slots = out.collect(), defaultdict(list)
    assert sorted((str(r["doc_id"]), r["text"] or "", r["__b"]) for r in got) == sorted((str(i), t or "", b) for i, t, b, _ in rows())
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == rendezvous(key, weights) and r["grown_shard"] == rendezvous(key, grown)
        assert r["grown_shard"] in (r["shard"], len(weights))  # a new shard takes rows only into itself
        text = r["text"] or ""
        slots[r["shard"]].append((r["slot"], (hashlib.md5(f"{key}|{zlib.crc32(text.encode())}".encode()).hexdigest(), key)))
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found))) and [o for _, o in found] == sorted(o for _, o in found)


def test_weights_are_kept_and_few_rows_move(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    got = sharding.shard(docs, [1.0, 2.0, 5.0], [1.0, 2.0, 5.0, 2.0]).collect()
    share = Counter(r["shard"] for r in got)
    assert all(abs(share[i] / 20_000 - w / 8) < 0.015 for i, w in enumerate((1, 2, 5)))
    assert abs(sum(r["shard"] != r["grown_shard"] for r in got) / 20_000 - 0.2) < 0.015


def test_empty_and_no_weight(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert sharding.shard(docs, [1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(docs, [0.0])
