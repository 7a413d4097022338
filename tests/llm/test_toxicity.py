import math
import random

import pytest

from lectern.llm import toxicity

CLEAN = "the river ran past a quiet mill and the miller counted sacks of grain".split()


def corpus(n, seed):
    """Documents of clean sentences; every third holds one bad sentence."""
    rng, out = random.Random(seed), []
    for i in range(n):
        sentences = [" ".join(rng.choices(CLEAN, k=8)) for _ in range(rng.randrange(2, 9))]
        if i % 3 == 0:
            sentences.insert(rng.randrange(len(sentences) + 1), f"you {rng.choice(['vile', 'rotten'])} grubworm go away")
        out.append((i, ". ".join(sentences) + ".", int(i % 3 == 0)))
    return out


def model(n=600):
    rows = corpus(n, 1)
    return toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])


def test_held_out_documents_and_the_sentence_at_fault():
    m, right = model(), 0
    for _, text, y in corpus(300, 2):
        score, spans = m.document(text)
        right += (score >= toxicity.THRESHOLD) == bool(y)
        assert 0 <= score <= 1
        if y:
            start, end, _ = max(spans, key=lambda s: s[2])
            assert "grubworm" in text[start:end] and "miller" not in text[start:end]
    assert right >= 297


def test_one_label_only_or_none():
    for texts, labels in (([], []), (["a b"], [0]), (["a b"], [1])):
        score, spans = toxicity.fit(texts, labels).document("a b")
        assert 0 <= score <= 1 and spans == []


def test_operator(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9001, "", "x"), (9001, "", "x"), (9002, "  \n", None)], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    trained = toxicity.train(docs, labels)
    got = toxicity.score(docs, trained).collect()
    assert len(got) == len(rows) + 4
    by_id = {r["doc_id"]: r for r in got}
    assert all((by_id[i]["score"] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows)
    for i in (None, 9001, 9002):
        assert by_id[i]["score"] == pytest.approx(trained.leak) and by_id[i]["sentences"] == []
    kept = toxicity.keep_clean(docs, trained)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id < 9000").collect()) == [i for i, _, y in rows if not y]
    assert toxicity.score(docs.limit(0), trained).count() == 0 and toxicity.keep_clean(docs.limit(0), trained).count() == 0


def test_held_out_labels_change_nothing(spark):
    rows = corpus(400, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.weights, a.bias, a.leak) == (b.weights, b.bias, b.leak)


def test_training_and_scoring_share_one_noisy_or(monkeypatch):
    """The chance of a fitted document, recomputed from its sentences by the
    formula that training uses, is its score; the floor holds in both."""
    m = model()
    for _, text, _ in corpus(60, 5):
        clean = 1 - m.leak
        for s in toxicity.SENTENCE.findall(text):
            evidence = sum(m.weights.get(f, 0.0) for w in toxicity.words(s) for f in toxicity.features(w))
            raw = 1 / (1 + math.exp(-(m.bias + evidence)))
            clean *= 1 - max(0.0, (raw - toxicity.FLOOR) / (1 - toxicity.FLOOR))
        assert m.document(text)[0] == pytest.approx(1 - clean)


def test_long_labelled_texts_are_learned_from(spark):
    rows = [(i, ". ".join([" ".join(CLEAN)] * 600 + (["you vile grubworm go away"] if i % 2 else [])), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    trained = toxicity.train(docs, labels)
    assert min(len(t) for _, t, _ in rows) > 20_000 and any(f.startswith("grub") for f in trained.weights)
    assert all((trained.document(t)[0] >= toxicity.THRESHOLD) == bool(y) for _, t, y in rows)


def test_the_sample_ends_by_order_not_by_length(spark, monkeypatch):
    rows = corpus(50, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(texts))
    toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", sum(map(len, seen[0][:7])) + 1)
    toxicity.train(docs, labels)
    assert seen[1] == seen[0][:7]
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1)
    toxicity.train(docs, labels)
    assert seen[2] == seen[0][:1]
